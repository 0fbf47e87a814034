import random

from test_leakage import hits, part

from rookery.llm import leakage as L

TWELVE = "Where does the ledger quarry keep its anchor sockets during nightly furnace runs?"
ITEMS = [(1, TWELVE), (2, "a b c d"), (3, "1 2 3 4 5 6 7 8 9 0 1 2"), (4, "go up")]
PAD = "nothing depends on that any more"


def found(text, items=ITEMS):
    return sorted(i for _, i in L.found_in(L.Index(L.own_passages(items)), [text]))


def test_an_altered_end():
    w = TWELVE.split()
    assert len(w) in range(10, 18)
    for x in (["zzz", *w[1:]], w[1:], [*w[:-1], "zzz"], w[:-1], [*w[:5], "zzz", *w[6:]]):
        assert found(f"{PAD} {' '.join(x)} {PAD}") == [1], x
    for x in (w[2:], ["zzz", *w[1:-1], "zzz"], [*w[:5], "zzz", *w[6:-1]]):
        assert found(f"{PAD} {' '.join(x)} {PAD}") == [], x
    run = part(1, 5, 18).split()
    first, last = run[0], run[-1]
    assert hits(f"{PAD} {' '.join([*run[:-1], last + 's'])} {PAD}") == [1]
    assert hits(f"{PAD} {' '.join([first[:-1] + 'x', *run[1:]])} {PAD}") == [1]
    assert hits(f"{PAD} {' '.join([*run[:-1], 'zzz'])} {PAD}") == []


def test_very_short_items():
    for x, ok in (("a b c d", [2]), ("A, b - (c) d!", [2]), ("a b x c d", []), ("ab c d", []), ("go up", [4]), ("go  UP.", [4]), ("go on up", [])):
        for k in (0, 1, 30, 77):
            assert found(f"{PAD} " * k + x + f" {PAD}" * k) == ok, (x, k)
    assert found(f"{PAD} 1 2 3 4 5 6 zz 8 9 0 1 2 {PAD}") == [3] and found(f"{PAD} 1 2 3 4 zz 6 zz 8 9 0 1 2 {PAD}") == []


def test_a_late_part_of_an_item_of_short_words():
    item = [(1, " ".join("abcdefghij"[i // 10] + " " + "0123456789"[i % 10] for i in range(60)))]
    own = item[0][1].split()
    assert L.own_passages(item)[0].needle
    for a, n, ok in ((100, 20, [1]), (60, 18, [1]), (60, 12, [])):
        assert found(f"{' '.join(own[a : a + n])} {PAD}", item) == ok, (a, n)


def test_frequent_words_do_not_hide_a_passage():
    rnd = random.Random(4)
    common = ["the", "of", "in"]
    own = [rnd.choice(common) if i % 2 else f"quarry{i}" for i in range(400)]
    item = [(1, " ".join(own))]
    noise = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    for a in (0, 180, 370):
        assert found(f"{noise(60)} {' '.join(own[a : a + 20])} {noise(60)}", item) == [1], a
