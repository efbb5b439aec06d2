from hunkyard.llm.handwritten import classify, judge, layout, lex, new_side, pieces, uniformity

GETTERS = "public class A {\n" + "".join(f"  public String getX{i}() {{ return this._f{i}; }}\n" for i in range(12)) + "}\n"
HAND = "import os\n\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\n\ndef save(path, text):\n    if not path:\n        raise ValueError(path)\n    with open(path, 'w') as f:\n        f.write(text)\n"
MIN = "!function(s){w.h=u?p:s,96}(this);for(var j=e.t;j--;)y(c[28]);" * 30
BLOB = "RAW = decode(\n" + "".join(f'    b"{c * 60}"\n' for c in "abcdefghijklm") + ")\n"


def test_layout_measures():
    lay = lambda t, f="slash": layout(lex(t, f))
    assert uniformity([x for x in lex(GETTERS, "slash") if x.tokens]) > 0.8
    assert uniformity([x for x in lex(HAND, "hash") if x.tokens]) < 0.2
    assert lay(MIN).expansion > 20 and lay(MIN).tight > 0.9
    assert lay(HAND, "hash").expansion < 2 and lay('x = "a;b;c"\n').canonical == ['x = "a;b;c"']
    assert lay("if(a){b=1;c=2}").canonical == ["if(a) {", "b = 1;", "c = 2", "}"]
    assert lay(BLOB, "hash").literal > 0.8 and lay('q = "select a, b from c where d = 1 and e = 2"', "hash").literal < 0.2


def test_lexer_keeps_comments_and_strings_apart():
    x = lex('a = "# no" # yes\n\nb = \'//\' // 2\n', "hash")
    assert [r.tokens for r in x] == [["a", "=", '"# no"'], ["b", "=", "'//'", "/", "/", "2"]] and x[0].comment == "# yes"
    assert [r.tokens for r in lex("/* a\nb */ c `x\ny` // d\n", "slash")] == [["c", "`x\ny`"]]
    assert lex("", "any") == [] and lex('"' * 5 + "\\", "slash")


def test_verdicts():
    say = lambda p, t, own="acme": judge(p, t, own).kind
    assert say("src/a/Uv.java", GETTERS) == "generated"
    assert say("a.py", HAND) is None
    assert say("vendor/auth/tariff_generator.py", HAND) is None
    assert say("vendor/fastfoo/fastfoo.py", HAND) is None
    assert say("dist/x.js", MIN) == "minified"
    assert say("src/x_data.py", BLOB) == "data"
    assert say("web/uv.lock", None) == "lock file"
    assert say("a.py", "# Code generated by protoc. DO NOT EDIT.\n" + HAND) == "generated"
    assert say("a.py", '# The writer below puts "Code generated ... DO NOT EDIT" on top of what it makes.\n' + HAND) is None
    assert say("a.js", "/*!\n * foolib v1.2.3\n * (c) 2019 the foolib contributors, MIT\n */\n" + HAND) == "vendored"
    assert say("a.js", "// Copied from the foolib project, release 1.2.3 (MIT).\n" + HAND) == "vendored"
    assert say("a.py", "# Copyright (c) the acme authors.\n" + HAND) is None
    assert say("", "") is None and say("a.yaml", "a:\n  b1: 1\n  b2: 2\n  b3: 3\n  b4: 4\n  b5: 5\n") is None


def test_layout_decides_without_a_path():
    say = lambda t: judge("", t, "acme").kind
    words = "alpha beta gamma delta omega sigma kappa lambda theta zeta".split()
    assert say("".join(f"ERROR_{w.upper()} = {i}\n" for i, w in enumerate(words[:8]))) is None
    assert say("".join(f"app.get('/v1/{w}', list_{w});\n" for w in words[:8])) is None
    assert say("def test_add():\n" + "".join(f"    assert add({i}, 1) == {i + 1}\n" for i in range(12))) is None
    comma = "var " + ",".join(f"{a}{b}=({b},{a})=>{a}.map(x=>x*{b}+{a}.{b}?{a}(x):{b}[x])" for a in "abcdefg" for b in "mnopq") + ";"
    assert say(comma) == "minified" and say(GETTERS) == "generated" and say(BLOB) == "data" and say(HAND) is None
    wrapped = "\n".join(MIN[i : i + 250] for i in range(0, len(MIN), 250))
    assert say(wrapped) == "minified"
    even = "".join(f'registry.bind("{w}", make_{w}_handler(schema.{w}, codec.{w}), options={{"name": "{w}"}})\n' for w in words)
    assert say(even) == "generated"
    assert say("export const rows = [\n" + "".join(f"  {{ id: {i}, name: '{w}', lat: {i}.5 }},\n" for i, w in enumerate(words * 2)) + "];\n") == "data"
    assert say("".join(f'[[package]]\nname = "{w}"\nversion = "1.{i}"\nchecksum = "{i}{"ab12" * 16}"\n\n' for i, w in enumerate(words))) == "lock file"
    key = "-----BEGIN PUBLIC KEY-----\\n" + "Ab9" * 300
    assert say("".join(f"def {w}(a):\n    return a.{w}\n\n" for w in words) + f'KEY = "{key}"\n') is None


def test_pieces_move_only_where_the_text_changed():
    code = "".join(f"int step_{c}(int a) {{\n    total += a * weight_{c};\n    return look_up(a, table_{c});\n}}\n" for c in "abcdefghijklmnop")
    full = lambda t: pieces(*layout(lex(t, "slash"))[1:3])
    a, b = full(code), full("// mine\n" + code.replace("    ", "\t").replace("weight_d", "weight_x"))
    assert sum(n for p, n in a.items() if p in b) >= 0.7 * sum(a.values()) > 0


def test_copies_in_other_owners_repositories(spark):
    lib = "".join(f"int step_{c}(int a) {{\n    total += a * weight_{c};\n    return look_up(a, table_{c});\n}}\n" for c in "abcdefghijklmnop")
    rows = [(1, "o/r", "x/lib.c", lib), (2, "p/s", "y/z.c", "/* local */\n" + lib.replace("    ", "  ")), (3, "o/t", "q.py", HAND), (4, "o/u", "q.py", HAND), (5, None, "w.c", lib.replace("int", "long"))]
    df = spark.createDataFrame([(*r, None) for r in rows], "diff_id bigint, repo string, file_path string, full_content string, patch string")
    got = {r.diff_id: (r.kind, r.route) for r in classify(df).collect()}
    assert got == {1: ("vendored", "pieces"), 2: ("vendored", "pieces"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_new_side():
    assert new_side("@@ -1 +1,2 @@\n a\n-b\n+c\n\\ No newline") == "a\nc"
    assert new_side("@@ -1,2 +0,0 @@\n-a\n-b") == "a\nb"


def test_table(spark):
    schema = "diff_id bigint, repo string, file_path string, full_content string, patch string, kind string"
    rows = [(1, "o/r", "src/U.java", GETTERS, None, "x"), (1, "o/r", "src/U.java", GETTERS, None, "x"), (2, "o/r", "src/U.java", None, "@@ -1 +1 @@\n-a\n+b", "x"), (3, None, None, None, None, "x"), (4, "o/r", "b.py", "", "", "x"), (5, "o/r", "c.py", HAND * 3000, None, "x")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.diff_id, r.kind or "") for r in classify(df).collect())
    assert got == [(1, "generated"), (1, "generated"), (2, "generated"), (3, ""), (4, ""), (5, "")]
    assert classify(df.limit(0)).count() == 0


def test_banner_below_a_long_licence():
    licence = [f"Licence text {'and so on ' * (i * 7 % 5)}in prose." for i in range(40)] + ["do not modify the License. You may add notices."]
    say = lambda p, t: judge(p, t, "acme").kind
    for mark in ("# ", "// "):
        head = "".join(f"{mark}{x}\n\n" for x in licence)
        assert say("a.py", head + mark + "Code generated by protoc. DO NOT EDIT.\n" + HAND) == "generated"
        assert say("a.py", head + HAND) is None
    block = "/*\n" + "\n".join(licence)
    assert say("a.js", block + "\nCode generated by protoc. DO NOT EDIT.\n*/\n" + HAND) == "generated"
    assert say("a.js", "<?php\n" + block + "\n*/\n// foolib v1.2.3\n" + HAND) == "vendored"
    assert say("a.js", block + "\n*/\n" + HAND + "// Code generated by protoc. DO NOT EDIT.\n") is None
