"""Ranked search, periodic runs and secret scans against plain versions, on nulls, blanks, ties, repeats, very long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import assignments, periodic, ranked, words
from touchline.llm import queries as registered

SCHEMA = "doc_id long, text string, id long, m long, bag string, kind string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def rows(texts):
    return [(i, t, 1, 2, "b", "k", 3) for i, t in texts]


# --- ranked search ----------------------------------------------------------------------


def plain_search(docs, items, k):
    bags = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(TERM.findall(lower(text or ""))) if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def searched():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "éa", "x1y", "K", "ſ"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(60)]
    docs += [(100 - i, docs[3][1]) for i in range(25)] + [(500 + i, docs[4][1].upper() + "\n.") for i in range(15)]
    docs += [(7, docs[7][1]), (None, docs[3][1]), (None, "only here"), (8, None), (9, ""), (10, " -- "), (11, "w1 " * 5000 + "w2")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12)))) for i in range(20)]
    return docs, items + [(3, items[3][1]), (4, "w5"), (90, None), (91, ""), (92, "nowhere"), (None, "w1 w2"), (93, docs[3][1])]


def test_search_equals_plain(spark, searched, monkeypatch):
    docs, items = searched
    d, q = spark.createDataFrame(rows(docs), SCHEMA).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items, 10)
    assert sorted(map(tuple, ranked.search(d, q).collect()), key=str) == want
    # many blocks of items, few cells and one partition give the same rows
    monkeypatch.setattr(ranked, "ITEM_BYTES", 200)
    monkeypatch.setattr(ranked, "CELLS", 20)
    assert sorted(map(tuple, ranked.search(d.coalesce(1), q).collect()), key=str) == want
    assert sorted(map(tuple, ranked.search(d, q, k=1).collect()), key=str) == plain_search(docs, items, 1)


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows([(1, "a b")]), SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(one, items.limit(0)).count() == 0
    assert ranked.search(one, spark.createDataFrame([(1, ".")], "item_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        ranked.search(one, items, k=0)


def test_a_class_is_scored_once_and_keeps_its_smallest_ids(spark):
    docs = spark.createDataFrame(rows([(i, "a b c") for i in range(400, 0, -1)]), SCHEMA)
    block = ranked.Block(["k"], ["a"])
    described = ranked._described(docs.select(F.col("doc_id").alias("id"), "text"), block).filter("kind = 0")
    got = ranked._classes(described, 400, 1200, 10).collect()
    assert [list(r["ids"]) for r in got] == [list(range(1, 11))]
    plan = ranked._classes(described, 400, 1200, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # copies beyond k stay in the task that read them


# --- periodic runs ----------------------------------------------------------------------


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_texts(seed):
    r = random.Random(seed)
    for _ in range(60):
        k, n = r.choice([1, 2, 2, 3, 5, 50]), r.randint(0, r.choice([12, 60, 200]))
        w = [f"é{r.randrange(k)}" for _ in range(n)]
        if n > 4 and r.random() < 0.7:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield r.choice([" ", "\n", " \t"]).join(w)
    yield from (None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", ("a a b " * 5) * 5, "x " * 4000 + "y " + "p q r " * 900, " ".join(f"w{i % 1500}" for i in range(9000)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_equal_plain(seed):
    texts = list(periodic_texts(seed))
    for size in (1, 7, len(texts)):  # alone and together
        for a in range(0, len(texts), size):
            part = texts[a:a + size]
            own, *run = periodic.runs_of(words.Words([(t or "").encode() for t in part]))
            got = list(zip(own.tolist(), *(x.tolist() for x in run), strict=True))
            for i, t in enumerate(part):
                w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
                if len(w) < 1000:
                    assert [x[1:] for x in got if x[0] == i] == plain_runs(w)
                    assert [x[1:] for x in got if x[0] == i] == sorted(x[1:] for x in got if x[0] == i)
    long = [x[1:] for x in got if len((texts[x[0]] or "").split()) > 6000]
    assert long == [(0, 4000, 1), (4001, 2700, 3), (0, 9000, 1500)]


def test_suffix_array():
    r = random.Random(4)
    for _ in range(50):
        import numpy as np

        s = np.array([r.randrange(3) for _ in range(r.randint(1, 60))] + [9])
        t = periodic.Suffixes(s)
        order = sorted(range(len(s)), key=lambda i: list(s[i:]))
        assert t.sa.tolist() == order and t.isa[t.sa].tolist() == list(range(len(s)))
        common = [next(k for k in range(len(s)) if s[i + k:i + k + 1].tolist() != s[j + k:j + k + 1].tolist()) for i, j in zip(order, order[1:], strict=False)]
        assert t.lcp.tolist() == [-1, *common, -1]


def plain_periodic(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if i is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    runs = plain_runs(w)
    keep = [x for j, x in enumerate(w) if not any(s + q <= j < s + n_ for s, n_, q in runs)]
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(keep)))


def test_periodic_query_equals_plain(spark, tmp_path):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [t for t in periodic_texts(9) if len((t or "").split()) < 1000]
    docs = list(enumerate(texts, 1000)) + [(i, texts[k % len(texts)]) for k, i in enumerate(ids)] + [(None, texts[5]), (1000, texts[0]), (ids[0], None), (ids[1], " ")]
    spark.createDataFrame(rows(docs), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = registered.op12(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_periodic(i, t) for i, t in docs), key=str)
    assert any(r["period"] and r["period"] > 3 for r in got)


def test_runs_keep_columns_and_refuse_clashes(spark):
    docs = spark.createDataFrame(rows([(1, "a a a a a a b")]), SCHEMA)
    out = periodic.periodic_runs(docs)
    assert out.columns == [*docs.columns, "n_words", "runs", "collapsed"] and out.first()["collapsed"] == "a b"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs.withColumn("runs", F.lit(1)))


# --- secret scans -----------------------------------------------------------------------


def plain_base(t):
    t = t or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found, key=lambda f: (f[1], ["assign", "access", "hex"].index(f[0])))


def secret_texts():
    r = random.Random(6)
    bits = ["password", "PassWD", "ſecret", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "abcdef12", "é", "\n", "\t", "long-value_99", "==", "x"]
    for _ in range(400):
        yield "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
    yield from (None, "", " ", "AKIA" * 6, "token = " + "f" * 64, "é" * 50 + "token='abcdefgh'", "x" * 200_000 + "secret:abcdefghi", "password = a+" * 20_000)


def test_secret_query_keeps_the_base_spans(spark, tmp_path):
    docs = list(enumerate(secret_texts())) + [(None, "token=abcdefgh"), (3, "token=abcdefgh")]
    spark.createDataFrame(rows(docs), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = registered.op13(spark, str(tmp_path)).collect()
    want = []
    for i, t in docs:
        base = plain_base(t)
        n = Counter(k for k, _, _ in base)
        want.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        spans = [(x.split(":")[0], int(x.split(":")[1])) for x in r["spans"].split(",") if x]
        assert spans == sorted(spans, key=lambda x: (x[1], assignments.KINDS.index(x[0])))


@pytest.mark.parametrize("text,secrets", [
    ('K = "s3cr3tValue99"\nOTHER = K\ndb_password = OTHER\n', ["s3cr3tValue99"]),
    ("db_password = LATER\nLATER = 's3cr3tValue99'\n", ["s3cr3tValue99"]),
    ("A = B\nB = A\npassphrase = A\nA = 'loop-value-1'\n", ["loop-value-1"]),
    ('config["api_key"] = "Zx81-abc-777"', ["Zx81-abc-777"]),
    ('password: str = "hunter22!"', ["hunter22!"]),
    ('dbPassword := "GoLang99key"', ["GoLang99key"]),
    ("'secret' => 'php-secret-1',", ["php-secret-1"]),
    ("<password>xmlPass123</password>", ["xmlPass123"]),
    ('user.setPassword("J4vaSetter")', ["J4vaSetter"]),
    ('env.put("API_KEY", "putValue77")', ["putValue77"]),
    ('passphrase = "abc99xyz" + TAIL\nTAIL = "tail-xyz-1"', ["abc99xyz", "tail-xyz-1"]),
    ("DB_PWD=plain1234pwd", ["plain1234pwd"]),
    ("export SIGNING_KEY=ab12cd34ef\n", ["ab12cd34ef"]),
    ("é = 1\nclient_credentials: 'é-Wert-123'", ["é-Wert-123"]),
    # not secrets
    ('name = "s3cr3tValue99"', []), ('password_hint = "pet2 name9"', []), ('token_url = "https://example.org/x1"', []), ("pwd = getpass()", []), ('if passphrase == "comparison1": x', []),
    ('client_pwd = "${CLIENT_SECRET}"', []), ('pwd = "changeme"', []), ("The pass: nothing here", []), ('max_tokens: 4096', []), ("x = 'a password: = b9b9b9b9'", []),
])
def test_assignments(text, secrets):
    assert [text[s:e] for kind, s, e, _, _ in assignments.spans_of(text) if kind == "literal"] == secrets


def test_no_span_twice_and_linear_time():
    assert [s[0] for s in assignments.spans_of('token = "abcd1234efgh"')] == ["assign"]
    import time

    start = time.perf_counter()
    for t in ('"a ' * 100_000 + "password", "'password " * 50_000, "<password>" * 50_000, "password." * 50_000, "k0 = 'v'\n" + "".join(f"k{i + 1} = k{i}\n" for i in range(30_000)) + "pwd = k30000"):
        assignments.spans_of(t)
    assert time.perf_counter() - start < 20


def test_scan_keeps_columns_and_refuses_clashes(spark):
    docs = spark.createDataFrame(rows([(1, "token=abcdefgh"), (2, None)]), SCHEMA)
    out = assignments.scan(docs)
    assert out.columns == [*docs.columns, "spans"] and [len(r["spans"]) for r in out.orderBy("doc_id").collect()] == [1, 0]
    assert assignments.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        assignments.scan(docs.withColumn("spans", F.lit(1)))
