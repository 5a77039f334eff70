"""Each operator against a brute-force version, on rows with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import chat, jaccard, language, main_text, order_minhash, packing, substring, toxicity, warc, winnow
from touchline.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, token string, size long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(20, 90))) for _ in range(25)]
    passage = " ".join(r.choice(vocabulary) for _ in range(20))
    for i in range(6):
        w = out[i].split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(out[i + 6] + "\n" + passage)
    out += [out[0], out[0].upper(), None, "", " \t\n", "one", "a b c", "a b c", "x " * 3000 + passage, passage + " " + passage]
    return [(100 - i if i % 2 else 200 + i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "k", "t", 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(docs, texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({v[1] for v in got.values()}) < len(got)


def test_components_grow_from_known_ones(spark):
    from touchline.llm.components import components

    rng = np.random.default_rng(3)
    chain = [(i + 1, i) for i in range(100, 130)]
    star = [(200, i) for i in range(201, 240)]
    loose = [tuple(map(int, x)) for x in rng.integers(300, 400, (60, 2))]
    parts = [chain[::2] + star[:20] + loose[:30], chain[1::2] + star[20:] + loose[30:] + [(7, 7), (1, 239), (1, 239)]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in parts[0] + parts[1]:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    known = None
    for part in parts:
        known = components(spark.createDataFrame(part, "a long, b long"), known)
    assert sorted(map(tuple, known.collect())) == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring(docs, texts, empty):
    ws = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    first = {}
    for i in sorted(ws):
        for j in range(len(ws[i]) - 12):
            first.setdefault(tuple(ws[i][j:j + 13]), i)
    want = {}
    for i, w in ws.items():
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < i:
                keep[j:j + 13] = [False] * 13
        want[i] = (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.deduplicated(docs).collect()}
    assert got == want
    assert any(v[1] for v in got.values())
    spans = substring.factors(docs).collect()
    assert all(f["length"] >= 13 and f["ref_id"] < r["id"] for r in spans for f in r["factors"])
    assert substring.deduplicated(empty).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_removed"]) for r in substring.deduplicated(df).collect()))
    assert got == [(-1, 0), (-1, 0), (5, 0), (5, 0), (9, 30)]
    assert sorted((r[0] or -1, r[2] or -1) for r in jaccard.jaccard_components(df).collect()) == [(-1, -1), (-1, -1), (5, 5), (5, 5), (9, 5)]


def test_winnow(spark, docs, texts, empty):
    long_item = next(t for _, t in texts if t and len(t.split()) > 40)
    items = [(1, " ".join(long_item.split()[5:30])), (2, "a b c"), (3, None), (4, "..."), (10, " ".join(long_item.split()[3:12])), (11, "ONE")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t or ""))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).add(str(i))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in winnow.decontaminate(docs, tests).collect()}
    for i, t in texts:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j:j + n])]
        assert got[i] == (len(w), len(hit), sorted(found)), i
    clean = winnow.decontaminate(docs, tests.filter("false")).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(clean) == (0, len(texts))


def test_order_minhash(docs, texts):
    rows = {r["doc_id"]: r for r in order_minhash.fingerprints(docs).collect()}
    ids = sorted(rows, reverse=True)
    text = {i: t or "" for i, t in texts}
    for k, i in enumerate(ids):
        half = len(text[i]) // 2
        assert rows[i]["edited"] == text[i][:len(text[i]) - half] + text[ids[(k + 1) % len(ids)]][:half]
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    by_text = {}
    for i, t in text.items():
        assert by_text.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
    # order counts: the same words the other way round are another fingerprint
    spark = docs.sparkSession
    words = [f"q{i}" for i in range(300)]
    pair = spark.createDataFrame([(" ".join(words),), (" ".join(words[150:] + words[:150]),)], "text string")
    a, b = (set(r[0]) for r in order_minhash.fingerprint(pair, "text", "fp").select("fp").collect())
    assert 0 < len(a & b) < len(a)


def test_order_minhash_numbers_occurrences(spark):
    line, one, two = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 60), ("a", 150), ("b", 150)))
    pairs = [(" ".join([line] * 3), " ".join([line] * 100)), (" ".join([one, two, one, two]), " ".join([one, one, two, two])), (one, f"{one} {one}")]
    df = order_minhash.fingerprint(order_minhash.fingerprint(spark.createDataFrame(pairs, "a string, b string"), "a", "fa"), "b", "fb")
    few, swapped, twice = (r[0] for r in df.select(order_minhash.likeness("fa", "fb")).collect())
    assert few < 0.2 and 0.5 < swapped < 0.92 and twice < 0.7
    # the kept k-mers of each class, by plain loops over the operator's own hashes
    texts = [" ".join(random.Random(s).choices([f"v{i}" for i in range(k)], k=n)) for s, (k, n) in enumerate([(3, 400), (40, 900), (900, 900), (1, 50), (2, 2), (5, 1)])]
    rows = order_minhash.fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "fp").collect()
    hashed = {}

    def xx(*values):
        if values not in hashed:
            hashed[values] = spark.range(1).select(F.xxhash64(*[F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for v in values[:-1]], F.lit(values[-1][0]).cast(values[-1][1]))).first()[0]
        return hashed[values]

    for r in (rows[0], rows[3], rows[4], rows[5]):
        w = [xx((x, "string")) for x in r["text"].split(" ")]
        seen, kept = {}, {}
        for i, k in enumerate([xx(a, (b, "long")) for a, b in zip(w, w[1:], strict=False)] or w):
            top = k >> 24 & (1 << 40) - 1
            o = seen[top] = seen.get(top, -1) + 1
            top = xx(top, (o, "int")) >> 24 & (1 << 40) - 1 if o else top
            kept.setdefault(top >> 34, []).append((top, i))
        want = []
        for c in sorted(kept, key=lambda c: c ^ 32):
            two = [top for top, _ in sorted(sorted(kept[c], key=lambda x: x[0])[:2], key=lambda x: x[1])]
            low = xx(two[0], (two[1], "long")) if len(two) > 1 else xx((two[0], "long"))
            want.append(c << 18 | low & 0x3FFFF)
        assert sorted(r["fp"]) == sorted(want)


def test_next_bucket_follows_sparse_ids(spark):
    ids = [1, 2, 300, 5 << 20, (5 << 20) + 1, 7 << 40, -4]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: int(r["next_text"]) for r in order_minhash.with_next(df, "doc_id", "text", ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: down[(k + 1) % len(down)] for k, i in enumerate(down)}


def test_warc(spark, tmp_path):
    big = "<p>" + "ä" * 80 + "</p>"
    pages = [(7, "u7", big), (3, "u3", big), (9, "u9", "small"), (2, "u2", "small"), (4, None, None), (5, "a\r\nb", "WARC/1.1\r\n\r\n" * 20), (6, "u6", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").drop("digest").withColumn("header", F.lit("x"))
    archive = warc.Archive(spark).write(df)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.parsed(archive.read()).collect()}
    for i, _, h in pages:
        data = (h or "").encode()
        again = len(data) >= 100 and i != min(p[0] for p in pages if p[2] == h)
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)
    assert spark.table(archive.payload_table).count() == len({h or "" for *_, h in pages})
    archive.export(str(tmp_path / "warc"))
    archive.drop()


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 1, "assistant", None), (1, 0, None, "<\\/s> <\\\\|im_end|>"), (2, None, "a\nb c", "x"), (2, 0, "assistant", "é" * 5000), (None, 0, "user", ""), (3, 0, "assistant", "y"), (3, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, source int")
    out = chat.formatted(df).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("learned", chat.learned())
    for r in out.collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["learned"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert out.count() == 5
    assert chat.formatted(df.filter("false")).count() == 0


def test_chat_leaves_no_raw_control_string(spark):
    texts = [f"{a}{c}{b}" for c in chat.CONTROL for a, b in (("a ", " b"), ("", ""), ("<", ">"), ("[", "]"))] + ["a [/INST]</s> b", "x</s", "[/INST", "<\\/s></s>"]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)] + [(i, 1, "assistant", "said") for i in range(len(texts))], "conv_id long, turn long, role string, text string")
    out = chat.formatted(df).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("learned", chat.learned())
    for r in out.collect():
        assert [tuple(t) for t in r["turns"]] == [("user", texts[r["conv_id"]]), ("assistant", "said")] and r["learned"] == "said"
        first, second = r["formatted"].removeprefix("[INST]user\n").removesuffix("[/INST]</s>").split("[/INST]</s>[INST]assistant\n")
        assert not [c for c in chat.CONTROL if c in first or c in second], r["formatted"]
    broken = spark.createDataFrame([("[INST]user\na </s> b[/INST]</s>",), ("[INST]user\na[/INST]</s>b[/INST]</s>",), ("[INST]user\na",), ("x[INST]user\na[/INST]</s>",)], "f string")
    assert [r[0] and r[0][0]["text"] for r in broken.select(chat.parsed(F.col("f"))).collect()] == [None] * 4


def test_main_text(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href="/">menu</a></li></ul></nav><div class="cookie-banner">We use cookies.</div>
    <article><h1>Head &amp; line</h1><p>First   part<br>goes on, and on it goes.<p>Second <b>part</b> &lt;here&gt;.<script>x</script></article>
    <div class="comments"><div class="comment"><p>I disagree with all of it.</p></div></div><footer>&copy; someone</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<article><p>cut off &am", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in main_text.extract(df, ["page_id", "url"]).collect()}
    assert got[1] == "Head & line\nFirst part goes on, and on it goes.\nSecond part <here>."
    assert got[2] == got[3] == ""
    assert got[4].startswith("cut off")
    pages = [main_text.blocks(p) for p in main_text.labelled_pages(150, 99)]
    pairs = [(a, int(b.main)) for p in pages for a, b in zip(main_text.model().decode(main_text.features(p)), p, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97


def test_toxicity(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    held = language.held_out(F.col("doc_id"))
    odd = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "idiot moron")], "doc_id long, text string")
    out = toxicity.score(docs.select("doc_id", "text").union(odd), labels.filter(~held))
    rows = out.join(labels, "doc_id", "left").withColumn("held", held).collect()
    assert len(rows) == docs.count() + 3
    assert all(0 <= r["score"] <= 1 for r in rows)
    judged = [(r["score"] >= 0.7, r["toxic"] == 1) for r in rows if r["held"] and r["toxic"] is not None]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9
    assert {r["score"] for r in toxicity.score(odd, labels.filter("false")).collect()} == {0.0}
    assert list(toxicity.isotonic([0, 1, 2, 3], [1, 1, 2, 1], [0.0, 0.8, 0.2, 1.0])) == pytest.approx([0, 0.4, 0.4, 1])


def test_packing(docs, texts, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces = packing.pack(packing.pieces(docs, VOCABULARY)).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    at, filled = {i: 0 for i in want}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = want[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(want[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        at[p["doc_id"]] += p["length"]
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(at[i] == len(w) for i, w in want.items())
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    assert packing.pack(packing.pieces(empty, VOCABULARY)).count() == 0


def test_levels_minimise_squares():
    r = random.Random(2)
    levels, count = packing.Levels(64), [0] * 64
    for _ in range(500):
        size = r.randint(1, 64)

        def cost(h, size=size):
            c = count[:]
            if h:
                c[h] -= 1
            if h + size < 64:
                c[h + size] += 1
            return sum(x * x for x in c)

        h = levels.level(size)
        assert cost(h) == min(cost(g) for g in range(65 - size) if g == 0 or count[g])
        for level, step in ((h, -1), (h + size, 1)):
            if 0 < level < 64:
                count[level] += step
                levels.count[level] += step


def test_tokens_are_the_tokenizers():
    tokenizer, encode = Tokenizer.from_file(VOCABULARY), encoder(VOCABULARY).encode
    r = random.Random(1)
    parts = ["a", "'", " ", "\n", "s", "re", "1", "!", "é", " ", "\t", "ve", "\x1c", "日本", "<|endoftext|>"]
    some = ["", *["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(800)]]
    assert [list(x) for x in encode(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    train = docs.filter(~held & F.col("lang").isNotNull())
    model = language.fit(train, language.known_labels(train))
    odd = spark.createDataFrame([(10**9, None, None), (10**9 + 1, "12 !", "en"), (None, "", "en")], "doc_id long, text string, lang string")
    rows = language.predict(docs.union(odd), model, ["doc_id", "lang"]).withColumn("held", held).collect()
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] is None or r["doc_id"] >= 10**9)
    judged = [r["lang_pred"] == r["lang"] for r in rows if r["held"] and r["doc_id"] < 10**9]
    assert sum(judged) / len(judged) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = language.fit(train.filter("false"), ())
    assert {r["lang_pred"] for r in language.predict(docs, none, ["doc_id"]).collect()} == {"und"}


def test_repeated_rows_come_out_as_often_as_they_went_in(spark, tmp_path):
    item = " ".join(f"t{i}" for i in range(20))
    rows = [(1, item), (1, item), (1, "other words"), (None, item), (None, item), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = winnow.decontaminate(docs, spark.createDataFrame([("a", item)], "item_id string, text string"))
    assert sorted(map(str, got.select("doc_id", "n_words", "n_hit").collect())) == sorted(map(str, [
        r for r in spark.createDataFrame([(1, 20, 20), (1, 20, 20), (1, 2, 0), (None, 20, 20), (None, 20, 20), (2, 0, 0), (2, 0, 0)], "doc_id long, n_words long, n_hit long").collect()]))
    # one response a payload, whatever is repeated
    page = "<p>" + "x" * 200 + "</p>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "v", page), (1, "w", page), (3, "u", "small"), (3, "u", "small"), (None, None, page + "2"), (None, None, page + "2")], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    archive = warc.Archive(spark, path).write(pages)
    got = warc.parsed(archive.read())
    assert got.count() == 8
    assert sorted((r["payload_digest"], r["n"]) for r in got.filter("record_type = 'response'").groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n")).collect()) == sorted(
        [(sha(page), 1), (sha(page + "2"), 1), (sha("small"), 2)])
    assert {r["refers_to"] for r in got.filter("record_type = 'revisit'").collect()} == {1, None}
    # another object finds the archive by its path alone
    assert sorted(map(str, warc.Archive(spark, path).read().collect())) == sorted(map(str, archive.read().collect()))
    assert all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in bytes(r["header"]) for r in archive.read().collect())
    assert warc.Archive(spark).write(pages.limit(0)).read().count() == 0


def test_jaccard_rows_of_one_id_are_one_node(spark):
    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    docs = spark.createDataFrame([(3, x), (5, x), (5, y), (9, y), (7, "alone here"), (None, x)], "doc_id long, text string")
    got = jaccard.jaccard_components(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 3), (5, 3), (5, 3), (9, 3), (7, 7), (None, None)], key=str)


def test_jaccard_bitmaps_never_hide_a_link():
    r = random.Random(12)
    for n in (40, 700, 5000, 30_000):
        for near in (0.81, 0.9, 0.7, 0.3):
            x = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
            keep = x[:int(n * near)]
            y = np.concatenate([keep, np.array([r.getrandbits(64) for _ in range(n // 20)], np.uint64)])
            wide = lambda s: jaccard._parity(s, max(jaccard.BITS, 1 << (2 * len(s) - 1).bit_length()))
            apart, true = jaccard._apart(wide(x), wide(y)), len(np.setxor1d(x, y))
            assert apart <= true and apart == jaccard._apart(wide(y), wide(x))
            assert apart > true // 2 or n < 700 or near < 0.5  # and tells long sets of like size apart


def test_language_counts_stay_inside_texts(spark):
    r = random.Random(2)
    rows = [("".join(r.choice("abcdé XY") for _ in range(r.choice([0, 1, 2, 30]))), r.choice(["a", "b"])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    one, many = (language.fit(docs.repartition(k), ("a", "b")) for k in (1, 7))
    assert np.array_equal(one.log_prob, many.log_prob) and np.array_equal(one.prior, many.prior)
    # against plain counts
    counts = np.full((len(one.log_prob), 2), 0.5)
    for t, x in rows:
        for i in range(len(t)):
            for n in (1, 2, 3):
                if i + n <= len(t):
                    gram = language._grams([t[i:i + n]], len(counts))[0][n - 1][0]
                    counts[gram, "ab".index(x)] += 1
    assert np.allclose(one.log_prob, np.log(counts / counts.sum(0)), atol=1e-5)


def test_next_row_of_hashed_and_hot_ids(spark, monkeypatch):
    r = random.Random(4)
    hashed = [r.getrandbits(64) - 2**63 for _ in range(300)]
    for ids in (hashed, [None] * 120 + hashed[:50], [7] * 200 + list(range(100)), [5]):
        rows = [(i, f"text {k}") for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = order_minhash.cuts_of(df.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("sid")), 16)
        at = order_minhash.placed(df.withColumn("sid", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))), found, "text", 4, 16)
        assert len(ids) < 100 or max(x["count"] for x in at.groupBy("slice", "part").count().collect()) <= 40
        got = {x["text"]: x["next_text"] for x in order_minhash.with_next(df, "doc_id", "text", ["text"]).collect()}
        keyed = {x["text"]: (x["doc_id"] if x["doc_id"] is not None else -(1 << 63), x["h"]) for x in df.withColumn("h", F.xxhash64("text")).collect()}
        down = sorted(keyed, key=keyed.get, reverse=True)
        assert got == {t: down[(k + 1) % len(down)] for k, t in enumerate(down)}
    assert order_minhash.with_next(df.limit(0), "doc_id", "text", ["text"]).count() == 0


def test_fingerprints_of_texts_without_spaces(spark):
    r = random.Random(9)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(400))
    df = spark.createDataFrame([(1, han), (0, han[:200] + "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(5)) + han[205:])], "doc_id long, text string")
    assert order_minhash.fingerprints(df).filter("doc_id = 1").first()["near_next"] > 0.8


def test_html_in_linear_time():
    import time

    from touchline.llm.html_blocks import blocks

    start = time.perf_counter()
    for page in ("<a " * 350_000, "<!--x-->" + "<a " * 350_000, "<div>x" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "<a '>" * 100_000, "<!--" * 100_000):
        blocks(page)
    assert time.perf_counter() - start < 12
    assert [b.text for b in blocks("<p>a<!-- b <p>c")] == ["a"] and [b.text for b in blocks("<p>a<!-->b-->c<a ")] == ["ac"]


def test_viterbi_equals_enumeration():
    import itertools

    r = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        field = main_text.Field({str(i): i for i in range(6)}, r.normal(size=(6, 2)), r.normal(size=(2, 2)))
        page = [[str(x) for x in r.choice(6, 2, replace=False)] for _ in range(n)]
        emit = [sum(field.emit[int(x)] for x in f) for f in page]
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(e[k] for e, k in zip(emit, y, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(y)))
        assert field.decode(page) == list(best)
    assert field.decode([]) == []


def test_main_text_of_an_empty_table(spark):
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id", "url"]).count() == 0


def test_a_block_is_let_go_while_it_is_read():
    import gc
    import weakref

    import pyarrow as pa

    from touchline.llm import substring

    class Batches:
        """Batches that are only known by weak references."""
        def __init__(self):
            self.seen = []

        def __iter__(self):
            for i in range(3):
                batch = pa.RecordBatch.from_arrays([pa.array(range(substring.BLOCK_ROWS))], names=["a"])
                self.seen.append(weakref.ref(batch))
                box = [batch]
                del batch
                yield box.pop()

    source = Batches()
    for n, block in enumerate(substring._blocks(source)):
        gc.collect()
        assert block.num_rows == substring.BLOCK_ROWS
        assert not any(r() is not None and r() is not block for r in source.seen), n
    assert len(source.seen) == 3
