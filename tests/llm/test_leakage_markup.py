from test_leakage import hits, part


def test_passages_inside_and_around_markup():
    t = part(2, 10, 24)
    w = t.split()
    for x in (
        f"<!-- {t} -->",
        "\n".join(f"<!-- {' '.join(w[i : i + 6])} -->" for i in range(0, 24, 6)),
        f'<img src="a.png" title="{t}" alt="">',
        f"&lt;!-- {t} --&gt;",
        f"&lt;p title='{t}'&gt;text",
        " ".join(f'<span class="a b c" data-x="one two three">{v}</span>' for v in w),
        " ".join(f'<span class="{"k " * 200}">{v}</span>' for v in w),
        " ".join(f"{v} <!-- a note of some words -->" for v in w),
        f"{' '.join(w[:9])} <!-- {' '.join(w[9:])} -->",
    ):
        assert hits(f"before that {x} and after") == [2], x[:60]
    assert hits(f'<p title="{part(2, 10, 15)}">{part(2, 30, 14)}</p>') == []
