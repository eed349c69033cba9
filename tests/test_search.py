"""Nested values, probes, windows, patterns and files against slow versions."""

import email.mime.application
import email.mime.multipart
import email.mime.text
import itertools
import json
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import nested as N
from lectern.operators import patterns as P
from lectern.operators import probe as S
from lectern.sources import files


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return {rng.choice("abcd"): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, "", " - ", "—", "text", 0, 7, True, False, "null", "[]"])


def paths(v, at=()):
    """All values that aren't containers, with their paths."""
    if isinstance(v, dict):
        return [p for k, x in v.items() for p in paths(x, (*at, k))]
    if isinstance(v, list):
        return [p for i, x in enumerate(v) for p in paths(x, (*at, i))]
    return [(at, v)]


def says(v):
    return any(not (x is None or isinstance(x, str) and x.strip() in N.EMPTY) for _, x in paths(v))


def slow_merge(new, old):
    if not says(new):
        return old if says(old) else None
    if not (isinstance(new, dict) and isinstance(old, dict)):
        return new
    return {k: slow_merge(new[k], old.get(k)) if k in new else old[k] for k in new.keys() | old.keys()}


def test_leaves_and_deep_merge(spark):
    rng = random.Random(1)
    made = [(i, value(rng), value(rng)) for i in range(400)]
    rows = [(i, json.dumps(a), json.dumps(b), "x") for i, a, b in made] + [(900, None, '{"a":1}', "x"), (901, None, None, "x"), (902, "not json", "-", "x")]
    df = spark.createDataFrame(rows, "id long, new string, old string, value string")
    got = {r.id: r for r in N.leaf_count(N.deep_merge(df, "new", "old"), "new").collect()}
    for i, a, b in made:
        want = slow_merge(a, b)
        assert (None if got[i].merged is None else json.loads(got[i].merged)) == want
        assert got[i].leaf_count == sum(says(x) for _, x in paths(a))
    assert got[900].merged == '{"a":1}' and got[901].merged is None and got[902].merged == '"not json"' and got[902].leaf_count == 1 and got[901].leaf_count == 0


def ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


def key(x):
    return re.sub(r"[\W_]+", " ", (x or "").lower()).strip()


def test_probe_equals_scan(spark):
    rng = random.Random(2)
    words = "river stone lamp field horse cloud paper".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
    nodes = [(i, text()) for i in range(150)] + [(200, None), (201, ""), (202, nodes0 := text()), (203, nodes0)]
    queries = [(i, rng.choice([text(), nodes[rng.randrange(150)][1] + " lamp", nodes[rng.randrange(150)][1].replace("stone", "stones")])) for i in range(60)] + [(99, None)]
    runs = lambda x: {" ".join(w[i : i + 4]) for w in [key(x).split()] for i in range(max(1, len(w) - 3))} if key(x) else set()
    want = {}
    for q, t in queries:
        asked, met = runs(t), []
        for n, u in nodes:
            shared = len(asked & runs(u))
            if asked and shared >= max(1, -(-len(asked) // 5)):
                met.append((-shared, n, u))
        scored = [(max(ratio(key(t), key(u)), ratio(" ".join(sorted(key(t).split())), " ".join(sorted(key(u).split())))), -s, -n) for s, n, u in sorted(met)[:3]]
        if scored and max(scored)[0] >= 0.6:
            want[q] = (-max(scored)[2], max(scored)[1])
    index = S.run_index(spark.createDataFrame(nodes, "node long, text string"))
    got = {r["query"]: (r.node, r.shared) for r in S.probe(spark.createDataFrame(queries, "query long, text string"), index, candidates=3, least=0.6).collect()}
    assert got == want and want


def test_token_subsets(spark):
    rng = random.Random(6)
    some = lambda: " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(5)))
    left, right = [(i, some()) for i in range(40)] + [(90, None), (91, "zzz")], [(i, some()) for i in range(60)] + [(90, None)]
    got = {tuple(r) for r in S.token_subsets(spark.createDataFrame(left, "left long, text string"), spark.createDataFrame(right, "right long, text string")).collect()}
    assert got == {(i, j) for i, x in left for j, y in right if x and y and set(x.split()) <= set(y.split())}


def slow_window(text, passage, n=6):
    wanted, size = {passage[i : i + n] for i in range(len(passage) - n + 1)}, len(passage) - n + 1
    runs = [text[i : i + n] for i in range(len(text) - n + 1)]
    if not wanted or not runs:
        return 0, 0.0
    each = [set(runs[i : i + size]) for i in range(max(1, len(runs) - size + 1))]
    values = [len(w & wanted) / len(w | wanted) for w in each]
    return values.index(max(values)), max(values)


def test_windows_and_located_changes(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    rows = [(i, t := some(rng.randrange(90)), rng.choice([some(rng.randrange(30)), t[5:25], ""])) for i in range(150)] + [(900, None, "abcdefgh"), (901, "short", "abcdefgh"), (902, "abcdefgh", None)]
    got = {r.id: (r.start, r.overlap) for r in S.best_window(spark.createDataFrame(rows, "id long, text string, passage string")).collect()}
    assert all(got[i] == pytest.approx(slow_window(t or "", p or "")) for i, t, p in rows)
    changes = [(i, t or "") for i, t, _ in rows]
    grams = lambda x: {key(x)[i : i + 6] for i in range(len(key(x)) - 5)}
    want = {}
    for i, _, p in rows:
        scored = [(len(grams(p) & grams(t)) / len(grams(p) | grams(t)), -c) for c, t in changes if grams(p) and grams(t)]
        if scored and max(scored)[0] >= 0.25:
            want[i] = -max(scored)[1]
    found = S.locate_change(spark.createDataFrame([(i, p) for i, _, p in rows], "context long, text string"), spark.createDataFrame(changes, "change long, text string"))
    assert {r.context: r.change for r in found.collect()} == want and want


def test_located_changes_in_blocks_and_long_lines(spark, monkeypatch):
    """Contexts in several blocks, changes counted in small parts, letters beyond ASCII, ties, and a line so long that work with the square of its length would take minutes."""
    monkeypatch.setattr(S, "CONTEXTS", 7)
    monkeypatch.setattr(S, "AT_ONCE", 64)
    monkeypatch.setattr(S, "SHARED_AT_ONCE", 5)
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abñ ") for _ in range(n))
    changes = [(i, some(rng.randrange(60))) for i in range(120)]
    changes += [(200 + i, t) for i, t in changes[:20]] + [(500, None), (501, some(1_200_000))]
    contexts = [(i, t if i % 3 else t[3:40] + "b") for i, t in changes[:40]] + [(90, ""), (91, None)]
    grams = lambda k: {k[i : i + 6] for i in range(len(k) - 5)}
    sets, want = {c: grams(key(t or "")) for c, t in changes}, {}
    for i, p in contexts:
        g = grams(key(p or ""))
        scored = [(len(g & x) / len(g | x), -c) for c, x in sets.items() if g and x]
        if scored and max(scored)[0] >= 0.25:
            want[i] = (-max(scored)[1], pytest.approx(max(scored)[0]))
    begun = time.monotonic()
    found = S.locate_change(spark.createDataFrame(contexts, "context long, text string"), spark.createDataFrame(changes, "change long, text string")).collect()
    assert {r.context: (r.change, r.similarity) for r in found} == want and len(want) > 20
    assert time.monotonic() - begun < 120


def test_every_example_matches_its_pattern(spark):
    rng = random.Random(4)
    rows = [(g, "".join(rng.choice(["A", "bc", "12", "-", ".", " ", "(", "#", "é", "7"]) for _ in range(rng.randrange(6)))) for g in (1, 2) for _ in range(60)] + [(3, "Art. 12"), (3, "Art. 7"), (3, None)]
    got = P.infer(spark.createDataFrame(rows, "id long, text string")).collect()
    for g, x in rows:
        assert not x or any(re.fullmatch(r.pattern, x) for r in got if r.id == g)
    assert sum(r.examples for r in got) == sum(bool(x) for _, x in rows)
    assert [r.pattern for r in got if r.id == 3] == [r"Art\.\s[0-9]{1,2}"]


def test_overlaps_agree_with_short_texts(spark):
    rng = random.Random(5)
    pieces = ["[0-9]", "[A-Z]", "[a-z]", "A", "b", r"\.", "1"]
    made = sorted({"".join(rng.choice(pieces) + rng.choice(["", "{2}", "{1,2}"]) for _ in range(rng.randrange(1, 3))) for _ in range(40)})
    texts = ["".join(t) for n in range(1, 5) for t in itertools.product("A1b.Zq", repeat=n)]
    matched = {p: {t for t in texts if re.fullmatch(p, t)} for p in made}
    got = {(r.a, r.b) for r in P.conflicts(spark.createDataFrame([(1, i, p) for i, p in enumerate(made)], "id int, level int, pattern string")).collect()}
    assert got == {(i, j) for i, p in enumerate(made) for j, q in enumerate(made) if i < j and matched[p] & matched[q]}


def test_docx(spark, tmp_path):
    word = files.WORD[1:-1]
    body = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{word}'><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = files.docx_paragraphs(spark, f"{tmp_path}/*.docx").orderBy("no").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.no, r.style, r.text, r.in_table) for r in rows] == [("a.docx", 0, "Heading1", "Title", False), ("a.docx", 2, None, "one\ttwo\nthree", False), ("a.docx", 3, None, "cell", True)]


def test_mhtml(spark, tmp_path):
    m = email.mime.multipart.MIMEMultipart("related")
    page = email.mime.text.MIMEText("<p>näive</p>", "html", "iso-8859-1")
    page["Content-Location"] = "https://example.org/a"
    m.attach(page)
    m.attach(email.mime.application.MIMEApplication(b"\x00\x01", "octet-stream"))
    (tmp_path / "a.mhtml").write_bytes(m.as_bytes())
    rows = files.mhtml_parts(spark, f"{tmp_path}/a.mhtml").orderBy("no").collect()
    assert [(r.type, r.location, r.text) for r in rows] == [("text/html", "https://example.org/a", "<p>näive</p>"), ("application/octet-stream", None, None)]
    assert bytes(rows[1].content) == b"\x00\x01"
    assert files.mhtml_parts(spark, f"{tmp_path}/a.mhtml").where(F.col("type") == "none").count() == 0


def test_a_key_is_asked_once_for_all_its_queries(spark):
    index = S.run_index(spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven")], "node long, text string"))
    queries = spark.createDataFrame([(10, "one two three four five six"), (11, "One, two three four five six."), (12, None), (13, "nothing of these words here"), (14, "one two three four five six")], "query long, text string")
    found = S.probe(queries, index)
    assert sorted(map(tuple, found.collect())) == [(q, 1, 3, 1.0) for q in (10, 11, 14)]
    assert re.search(r"Aggregate \[asked#\d+\]", found._jdf.queryExecution().optimizedPlan().toString())
