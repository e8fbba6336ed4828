import pytest

from colligo.llm.generated import classify, not_hand_written

OWN = ("lanternworks",)
CODE = "using System;\n\nnamespace A\n{\n    class B { void C() { D(); } }\n}\n"
HAND = [
    ("src/a.cs", CODE), ("src/Vendors/x1/A.cs", CODE), ("app/vendor_portal/A.cs", CODE), ("build/minifier/A.cs", CODE), ("tools/CodeGeneration/A.cs", CODE), ("src/generator/A.js", "class A {}\n"), (None, None), ("a.py", None), (None, ""), ("a.py", "  \n"),
    ("a.cs", "// Copyright (c) Lanternworks contributors.\n// Licensed under the MIT License.\n" + CODE), ("a.cs", "// Do not edit the numbers below without asking the billing team.\n" + CODE), ("a.py", "# Names are generated from the order id at run time.\nx = 1\n"),
    ("a.js", 'const header = "<auto-generated>";\nwrite(header);\n'), ("a.py", 'header = "Code generated by rulec. DO NOT EDIT."\nwrite(header)\n'), ("a.js", "const table = [1, 2, 3, 4, 5, 6, 7, 8];\nuse(table);\n"), ("a.js", 'const help = "' + "some words " * 80 + '";\nshow(help);\n'),
]
NOT_HAND = [
    ("node_modules/x/a.js", CODE), ("src/third_party/lib/a.cs", CODE), ("a\\vendor\\x\\A.cs", CODE), ("x/external/gravel/A.cs", CODE), ("p/packages/thing.1.2.3/lib/A.cs", CODE), ("x/wwwroot/lib/ui/a.js", "a()"), ("gen/out/A.cs", CODE), ("x/obj/Debug/A.cs", CODE), ("x/__generated__/a.py", "x = 1"), ("a.g.cs", CODE), ("a.Designer.cs", CODE), ("a_pb2.py", "x = 1"), ("a.min.js", "x"), ("main.f95d76f1.js", "x"), ("package-lock.json", "{}"), ("yarn.lock", ""),
    ("a.cs", "// <auto-generated>\n" + CODE), ("a.cs", "﻿// Code generated by tspgen 2.1. DO NOT EDIT.\r\n" + CODE), ("a.py", "# This file was produced by forge 1.2; changes will be lost.\nx = 1\n"), ("a.py", "# Dieser Code wurde von einem Werkzeug erzeugt und wird ueberschrieben.\nx = 1\n"), ("a.cs", "// Copyright (c) Lanternworks contributors.\n//\n// @generated by press\n" + CODE), ("a.js", "class A {}\n/* eslint-disable */ /* @generated */\n"),
    ("a.cs", "namespace A\n{\n    [GeneratedCode(\"tspgen\", \"2.1\")]\n    class B { }\n}\n"), ("a.py", "x = 1\n__generated_by__ = \"forge 8\"\n"), ("a.cs", "// brindle 1.2.3\n// Copyright (c) the brindle authors. All rights reserved.\n" + CODE), ("a.cs", "// Vendored from brindle 1.2.3 (commit 12ab), no local patches.\n" + CODE), ("a.js", "/*! moth v1.2.3 | (c) moth authors | MIT | https://moth.example.invalid */\nclass A {}\n"),
    ("a.js", "!function(){" + "void 0!==a.b&&(c=a.b(1));if(!d){e.f(2);g=3}" * 60 + "}();"), ("a.py", "BLOB = (\n" + '    b"' + "Wgg0DaGRDFsKTiLed/qYIUpqxEFNfonDHYRkV7Yt8CnJyf2" + '"\n' * 1 + ('    b"' + "mmyZgjSJCoDnovmwIPjeNqCQhde2z2T49lqFeL7NLFo2AL" + '"\n') * 40 + ")\n"), ("a.py", "W = [\n" + "    0.900508, 0.084770, 0.812436, 0.034396,\n" * 60 + "]\n"), ("a.js", "function step(s, c) {\n  switch (s) {\n" + "".join(f"    case {i}: return c === {i % 90} ? {i + 1} : {i + 2};\n" for i in range(90)) + "  }\n}\n"),
]


@pytest.mark.parametrize("path,text", HAND)
def test_hand_written(path, text):
    assert classify(path, text, OWN) == []


@pytest.mark.parametrize("path,text", NOT_HAND)
def test_not_hand_written(path, text):
    assert classify(path, text, OWN)


def test_operator(spark):
    rows = [(i, p, t, "clash") for i, (p, t) in enumerate(HAND + NOT_HAND)]
    df = spark.createDataFrame(rows + rows[-1:], "file_id bigint, path string, raw_text string, reasons string")
    got = not_hand_written(df, ["Lanternworks"])
    assert got.columns == ["file_id", "reasons"]
    assert sorted(r[0] for r in got.collect()) == sorted([*range(len(HAND), len(rows)), len(rows) - 1])
    assert not_hand_written(df.limit(0)).count() == 0


def test_very_long_text_is_read_whole():
    assert classify("a.cs", "// x\n" * 200_000 + "// @generated by x\nclass A {}\n")


@pytest.mark.parametrize("n", [150, 250, 600])
def test_data_does_not_depend_on_the_number_of_names(n):
    def name(k):
        return "".join(chr(97 + k // 26**j % 26) for j in range(3)).upper()

    assert classify("a.py", "".join(f'BLOB_{name(k)} = "{"QmFzZTY0IGJ5dGVzIG9m" * 12}{k:08d}"\n' for k in range(n)))
    assert classify("a.cs", "int[] t = {" + "12, 7, 305,\n" * 10_000 + "};\n" + "".join(f"t[0] = {name(k)};\n" for k in range(min(n, 290))))
    assert classify("a.py", "".join(f"def f_{name(k)}(a):\n    return a + g_{name(k)}(a)\n" for k in range(n))) == []


def test_owners_are_given():
    text = "// Copyright (c) Lanternworks contributors.\n" + CODE
    assert classify("a.cs", text) == ["foreign licence"] and classify("a.cs", text, OWN) == []


def test_short_data_and_keys():
    assert classify("a.py", "T = [" + "1,2," * 40 + "]\n") == ["data as code"] and classify("a.py", "T = [" + "1,2," * 20 + "]\n") == []
    assert classify("a.js", 'const key = "-----BEGIN PUBLIC KEY-----' + "QmFzZTY0" * 80 + '-----END PUBLIC KEY-----";\nuse(key);\n') == []
