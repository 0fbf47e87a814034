import random

from rookery.llm import leakage as L

WORDS = "bramble counter index harbor anchor partial ledger quarry lantern socket meadow cistern rivet gasket pasture furnace tariff shackle estuary mortar".split()
rnd = random.Random(11)
SHARED = "Find the entry points that matter for this change and list what to read first."


def passage(n):
    return " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(90)}" if i % 3 else f"lib/{rnd.choice(WORDS)}_{i}.py" for i in range(n))


ITEMS = [(1, SHARED + " " + passage(40) + "."), (2, SHARED + " " + passage(60) + "."), (3, "Why does trim-rivet return a brittle pallet to loomcast?"), (4, None), (5, "  ")]
OWN = {i.item_id: t.split(". ", 1)[1].rstrip(".") if i.item_id < 3 else t for i, (_, t) in zip(L.own_passages(ITEMS), ITEMS)}


def hits(text):
    return sorted(i for _, i in L.found_in(L.Index(L.own_passages(ITEMS)), [text]))


def part(item, a, n):
    return " ".join(OWN[item].split()[a : a + n])


def test_bounds_of_length():
    pad = "Nothing depends on it any more."
    assert hits(f"{pad} {part(1, 5, 18)} {pad}") == [1]
    assert hits(f"{pad} {part(1, 5, 17)} {pad}") == []
    assert hits(f"{part(1, 0, 25)} {pad} {part(2, 9, 30)}") == [1, 2]
    assert hits(SHARED) == [] and hits(f"{SHARED} {pad}") == []
    assert hits(f"{pad} Why does trim-rivet return a brittle pallet to loomcast? {pad}") == [3]
    assert hits("Why does trim-rivet return a noisy pallet to loomcast?") == []


def test_one_word_in_ten():
    w = part(1, 3, 30).split()
    for kind in ("alter", "drop", "add"):
        for n, ok in ((1, True), (3, True), (9, False)):
            x = list(w)
            for i in sorted(range(2, 28, max(2, 26 // n)), reverse=True)[:n]:
                if kind == "alter":
                    x[i] = "zzz"
                elif kind == "drop":
                    del x[i]
                else:
                    x.insert(i, "zzz")
            assert (hits("so: " + " ".join(x)) == [1]) is ok, (kind, n)


def test_disguises():
    t = part(2, 10, 24)
    look = str.maketrans("aeocp", "аеоср")
    wrapped = [t[i : i + 40] for i in range(0, len(t), 40)]
    for x in (
        t.upper().replace(".", "").replace(",", ""),
        t.translate(look),
        "\n".join("// " + s for s in " ".join(t.split()).replace(" ", "\n", 5).split("\n")),
        t.replace(" ", "&nbsp;", 4).replace(" ", "<br/> ", 2),
        " ".join(f"**{w}**" if i % 4 else f"`{w}`" for i, w in enumerate(t.split())),
        t.replace(" ", "\\u0020", 3).replace(" ", "\\n", 3),
        "".join(c + ("​" if i % 9 == 0 else "\xad" if i % 9 == 4 else "") for i, c in enumerate(t)),
        " ".join(c for c in t.replace(" ", "　").split("\x00")),
    ):
        assert hits(f"before that {x} and after") == [2], x[:60]
    assert wrapped


def test_against_plain_alignment():
    """Every run of 18 whole words that a word-by-word search finds is found."""
    ix = L.Index(L.own_passages(ITEMS))
    for _ in range(60):
        item, n, a = rnd.choice((1, 2)), rnd.randrange(10, 30), rnd.randrange(0, 12)
        text = f"{passage(rnd.randrange(40))} {part(item, a, n)} {passage(rnd.randrange(40))}"
        got = {i for _, i in L.found_in(ix, [text])}
        words = " ".join(text.split())
        want = {k for k in (1, 2) if any(part(k, s, 18) in words for s in range(len(OWN[k].split()) - 17))}
        assert want <= got and (got == want or n >= 17)


def test_rows(spark):
    docs = spark.createDataFrame([(1, part(1, 0, 30)), (2, part(1, 0, 30)), (3, None), (4, ""), (5, "x" * 200_000 + " " + part(2, 0, 30) + " y" * 50_000)], "doc_id bigint, text string").selectExpr("*", "'q' as k", "'r' as t", "1 as item_id")
    items = spark.createDataFrame(ITEMS, "item_id bigint, item_text string").selectExpr("*", "1 as doc_id")
    assert sorted(tuple(r) for r in L.contaminated(docs, items).collect()) == [(1, 1), (2, 1), (5, 2)]
    assert L.contaminated(docs.limit(0), items).count() == 0 and L.contaminated(docs, items.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, part(1, 0, 30)), (2, part(2, 0, 30))], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, item_text string")
    monkeypatch.setattr(L, "BLOCK_BYTES", 1)
    assert sorted(tuple(r) for r in L.contaminated(docs, items).collect()) == [(1, 1), (2, 2)]
