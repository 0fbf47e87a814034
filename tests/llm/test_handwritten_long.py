import random

from test_handwritten import HAND, why

from rookery.llm import handwritten as H


def test_records_on_one_long_line_are_data():
    rec = lambda i: f'{{"region_name": "north harbor {i} (old)", "warehouse": "quarry", "holders": ["mortar keeper", "gasket {i}"]}}'
    assert why("REGIONS = [" + ", ".join(map(rec, range(60))) + "]\n") == "data"
    assert why("REGIONS = [" + ", ".join(map(rec, range(60))) + "]\n" + HAND * 60) is None


def test_a_minified_line_among_short_ones():
    rnd = random.Random(2)
    name = lambda: "".join(rnd.choice("abcxyz") for _ in range(rnd.choice((1, 1, 2))))
    line = "".join(f"function {name()}({name()},{name()}){{return {name()}[{name()}]||{rnd.randrange(99)}}};" for _ in range(130))
    call = lambda: "".join(rnd.choice((" + cart", ".weigh(cargo)", "[harbor]", " || quarry", "(limit, 3)", " && !ledger.empty")) for _ in range(rnd.randrange(1, 5)))
    short = "\n".join(f"const canopy = shipment{call()};" for _ in range(100))
    assert len(line) > 4000 and H.layout(f"{short}\n{line}\n")["mean_line"] < 110
    assert why(f"{short}\n{line}\n", "src/a.ts", "typescript") == "minified"
    assert why(f"{short}\n// {'a b c ' * 900}\n", "src/a.ts", "typescript") is None
    assert why(f"{short}\nconst q = '{'select the carved canopy from every harbor ' * 40}';\n", "src/a.ts", "typescript") is None


def test_share_of_alphanumerics():
    rnd = random.Random(3)
    assert why("\n".join("".join(rnd.choice("abcdefXYZ0189") for _ in range(50)) for _ in range(40))) == "data"
    assert why("\n".join("".join(rnd.choice("#$%&*+-./;<>|~ ") for _ in range(50)) for _ in range(40)), "a.ts", "typescript") == "data"


def test_long_lines_have_a_shape():
    line = lambda i: f"field{i} = " + " + ".join(f"shipment_{i}_{j}.weightOfCargo" for j in range(100))
    assert len(line(0)) > 2000 and H.layout("\n".join(map(line, range(20))))["repeats"] == 20
