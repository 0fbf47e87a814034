import random

from rookery.llm import handwritten as H

HAND = "import json\n\n\ndef weigh(cart, limit=3):\n    # keeps both in step\n    if not cart:\n        return None\n    return [price(x) for x in cart if x != limit]\n"


def why(text=HAND, path="src/a.py", language="python", root="/srv/r"):
    return H.judged(text, path, language, root)


def test_hand_written():
    assert why() is None
    assert why("# Not generated: the stubs live in gen/, this wrapper is ours.\n" + HAND) is None
    assert why("# Scaffolded once from a template in 2023 and maintained by hand since; edit freely.\n" + HAND) is None
    assert why("# Copyright Ours. All rights reserved.\n" + HAND) is None
    assert why('# emitter: writes the line "Code generated by x. DO NOT EDIT." at the top of what it prints\n' + HAND) is None
    assert why("# idea borrowed from wicket, written anew because its MIT License copy did not fit\n" + HAND) is None
    for p in ("app/vendor_portal/a.py", "src/vendors/invoice.py", "app/generated_reports/a.py", "app/external_api/a.py", "src/codegen/emit_a.py"):
        assert why(path=p) is None, p
    assert why('Q = "select ' + ", ".join(f"carve_canopy_{i}" for i in range(40)) + '"\n' + HAND) is None
    assert why(HAND + "ROWS = (\n" + "".join(f'    ("a_{i}", {i}.5),\n' for i in range(5)) + ")\n" + HAND) is None


def test_generated_and_copied():
    for head in ("# Code generated by forge 1.2. DO NOT EDIT.", "# @generated by x", "# Fichier produit par x 1.2 - ne pas modifier.", "# Automatisch erzeugt aus a.xsd mit x. Nicht von Hand bearbeiten.", "# <auto-generated> x </auto-generated>", "#\n#\n# do not modify by hand: output of `x`"):
        assert why(head + "\n" + HAND) == "generated", head
    assert why(HAND + "\n# Code generated by forge 1.2. DO NOT EDIT.\n\n") == "generated"
    for head in ("# flint v1.2.3\n# (c) the flint authors. Released under the MIT License.", "# Imported verbatim from the flint distribution, version 1.2.", "# vendored from flint@1.2.3, local patches marked PATCH", "# Copyright (c) 2019-2024 The flint Project Developers\n# Permission is hereby granted, free of charge"):
        assert why("﻿" + head + "\r\n" + HAND) == "vendored", head
    assert why("\n".join(f"  field :a_{i}, {i}, type: :string" for i in range(30)), "lib/a.ex", "elixir") in ("generated", "data")
    for p in ("third_party\\x\\a.py", "./Vendor/a.py", "a/node_modules/b.ts", "priv/static/libs/x/a.py", "src/main/resources/webjars/x/a.clj"):
        assert why(path=p) == "vendored", p
    assert why(root="/srv/r/node_modules/@mirror/x") == "vendored"
    assert why(path="src/gen/a.py") == "generated" and why(path="a_pb2.py") == "generated"


def test_minified_and_data():
    rnd = random.Random(1)
    name = lambda: "".join(rnd.choice("abcxyz") for _ in range(rnd.choice((1, 1, 2))))
    code = "".join(f"function {name()}({name()},{name()}){{return {name()}[{name()}]||{rnd.randrange(99)}}};" for _ in range(60))
    assert why(code, "src/a.ts", "typescript") == "minified"
    assert why("\n".join(code[i : i + 380] for i in range(0, len(code), 380)), "src/a.ts", None) == "minified"
    assert why('ICON = "' + "".join(rnd.choice("abcdefXYZ0189+/") for _ in range(900)) + '"\n') == "data"
    assert why("ROWS = (\n" + "".join(f'    ("row_{i}", {rnd.uniform(-90, 90):.5f}, {rnd.uniform(-180, 180):.5f}),\n' for i in range(60)) + ")\n") == "data"
    assert why("A = [" + ", ".join(f'{{"id": {i}, "sku": "x{i}_long_name", "w": {rnd.random()}}}' for i in range(30)) + "]\n") == "data"


def test_odd_rows(spark):
    assert why(None) is None and why("") is None and why(" \n") is None and why(None, "vendor/a.py") == "vendored"
    assert H.judged(HAND, None, None, None) is None
    assert why(HAND * 3000) is None
    cols = "fallback_id bigint, raw_context string, path string, language string, root_path string, reason string, k string"
    df = spark.createDataFrame([(1, HAND, "vendor/a.py", None, None, "", ""), (1, HAND, "vendor/a.py", None, None, "", ""), (2, None, None, None, None, "", "")], cols)
    assert sorted((r["fallback_id"], r["reason"]) for r in H.classified(df).where("reason is not null").collect()) == [(1, "vendored"), (1, "vendored")]
    assert H.classified(df.limit(0)).count() == 0
