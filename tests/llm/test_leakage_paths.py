"""Long added words, repetitive surroundings, other scripts, and random edits against a plain search over all runs."""

import random

import pytest
from test_leakage import hits, part

from rookery.llm import leakage as L

WORDS = "bramble counter index harbor anchor partial ledger quarry lantern socket meadow cistern rivet gasket pasture furnace tariff shackle estuary mortar".split()


def found(text, items):
    return sorted(i for _, i in L.found_in(L.Index(L.own_passages(items)), [text]))


def plain_search(item, text):
    """Whether some words of the item and some of the text differ by at most one word in ten, both ends left whole."""
    need = min(L.RUN, len(item))
    for a in range(len(item)):
        for b in range(len(text)):
            if item[a] != text[b]:
                continue
            row = {0: 0} | {k: k for k in range(1, len(item))}
            prev = list(range(len(text) - b + 1))
            for i in range(a, len(item)):
                now = [prev[0] + 1]
                for j in range(b, len(text)):
                    now.append(min(prev[j - b] + (item[i] != text[j]), prev[j - b + 1] + 1, now[-1] + 1))
                n = i - a + 1
                if n >= need and any(now[j - b + 1] <= n // 10 for j in range(b, len(text)) if text[j] == item[i]):
                    return True
                prev = now
                if min(now) > len(item) // 10:
                    break
            assert row
    return False


@pytest.mark.parametrize("seed", range(6))
def test_random_edits_in_repetitive_text(seed):
    rnd = random.Random(seed)
    words = WORDS[: 4 if seed < 3 else 12]
    for _ in range(12):
        item = [rnd.choice(words) + str(rnd.randrange(3)) for _ in range(rnd.randrange(18, 45))]
        a, n = rnd.randrange(0, 8), rnd.randrange(16, 34)
        x = item[a : a + n]
        for _ in range(rnd.randrange(0, 5)):
            i = rnd.randrange(len(x))
            kind = rnd.randrange(3)
            if kind == 0:
                x[i] = "zzz"
            elif kind == 1:
                del x[i]
            else:
                x.insert(i, rnd.choice(words) + "1")
        text = [rnd.choice(item) for _ in range(20)] + x + [rnd.choice(item) for _ in range(20)]
        want = plain_search(item, text)
        got = found(" ".join(text), [(1, " ".join(item))]) == [1]
        assert got or not want, (item, text)
        if got and not want:  # only an altered end that resembles the item's word, or words joined alike, may go beyond
            assert len(x) >= L.RUN - 2


def test_long_added_words_stay_in_the_bands():
    w = part(2, 5, 22).split()
    for size in (60, 110, 5000):
        x = [*w[:6], "q" * size, *w[6:14], "z" * size, *w[14:]]
        assert hits("so: " + " ".join(x) + " and on") == [2], size


def test_edits_close_together_in_a_long_run():
    w = part(2, 5, 30).split()
    assert hits(" ".join([*w[:12], "zz", w[13], "zz", w[15], "zz", *w[17:]])) == [2]


def test_other_scripts():
    items = [(1, "索引 快照 需要 在 每次 提交 之后 重新 建立"), (2, "Проверка индекса после каждого изменения обязательна"), (3, "索引在提交之后失效")]
    assert found("说明：索引 快照 需要 在 每次 提交 之后 重新 建立。", items) == [1]
    assert found("索引 快照 需要 在 每次 提交", items) == []
    assert found("... ПРОВЕРКА индекса после каждого изменения, обязательна!", items) == [2]
    assert found("我们 知道 索引在提交之后失效 了", items) == [3]


def test_joined_and_split_words():
    w = part(2, 5, 24).split()
    assert hits("_".join(w)) == [2] and hits("%20".join(w[:3]) + " " + " ".join(w[3:])) == [2]
    assert hits(" ".join(x[:3] + "-\n" + x[3:] if i % 5 == 0 else x for i, x in enumerate(w))) == [2]
