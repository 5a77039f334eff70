"""The whole pipeline against a plain version that applies the stages one after another to lists of rows."""

import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from touchline.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def tables():
    """Two languages with words of their own, copies, near copies, shared passages, leaks, and texts without letters."""
    r = random.Random(11)
    words = {"en": [f"{a}{b}ing" for a in "bdfgklmn" for b in ("ow", "ea", "oo", "ay", "igh")], "de": [f"{a}{b}ung" for a in "prstvwzj" for b in ("ä", "ü", "ö", "ei", "sch")]}
    rows = [(lang, [r.choice(words[lang]) + r.choice("abcdefgh") for _ in range(r.randint(40, 120))]) for lang in ("en", "de") for _ in range(14)]
    passage = [r.choice(words["en"]) for _ in range(30)]
    item = [r.choice(words["de"]) for _ in range(25)]
    made = list(rows)
    for lang, w in rows[:8]:
        near = list(w)
        near[r.randrange(len(near))] = "otherwise"
        made += [(lang, near), (lang, w)]
    made += [(lang, w[:20] + passage + w[20:]) for lang, w in ((l_, [x + "y" for x in w]) for l_, w in rows[8:12])]
    made += [(lang, [x + "z" for x in w[:30]] + item) for lang, w in rows[16:19]]
    made += [("de", [x + "q" for x in rows[20][1]] * 14 + item[:14]), ("en", passage), ("en", ["only", "three", "words"]), ("en", ["only", "THREE", "words"])]
    docs = [(7 * i % 101 + 1, " ".join(w), lang, "hot" if i % 3 else None, None) for i, (lang, w) in enumerate(made)]
    docs += [(200, None, "en", "s", 0), (201, "", None, "s", 0), (202, "12 34 -- !", "de", "s", 0), (203, " \n\t", None, None, None)]
    r.shuffle(docs)
    return docs, [(1, re.sub("[a-z]", lambda m: m[0].upper(), " ".join(item))), (2, None), (3, "...")]


def without_near_copies(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[low[i]] == low[i] for i in low):
            break
    return [(i, t) for i, t in docs if low[i] == i]


def without_passages(docs):
    words = {i: WORD.findall(t) for i, t in docs}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j:j + 13]), i)
    out = []
    for i, t in docs:
        gone = {j + k for j in range(len(words[i]) - 12) if first[tuple(words[i][j:j + 13])] < i for k in range(13)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(words[i]):
            out.append((i, " ".join(w for j, w in enumerate(words[i]) if j not in gone)))
    return out


def without_leaks(docs, items):
    windows = set()
    for _, t in items:
        w = ITEM_WORD.findall(lower(t or ""))
        windows |= {tuple(w[j:j + 13]) for j in range(max(1, len(w) - 12))} if w else set()
    out = []
    for i, t in docs:
        w = ITEM_WORD.findall(lower(t))
        hit = {j + k for n in {len(x) for x in windows} for j in range(len(w) - n + 1) if tuple(w[j:j + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


def test_run_equals_plain_stages(spark, tables, tmp_path):
    docs, items = tables
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    lettered = [(i, t) for i, t, *_ in docs if any(c.isalpha() for c in t or "")]
    unique = without_near_copies(lettered)
    cut = without_passages(unique)
    clean = without_leaks(cut, items)
    # every stage has something to do
    assert len(docs) > len(lettered) > len(unique) >= len(cut) > len(clean) > 0
    assert set(cut) - set(unique)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), packing.LENGTH):
            part = ids[at:at + packing.LENGTH]
            want.add((i, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {(p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in rows}
    assert len(got) == len(rows)
    assert got == want
    filled = {}
    for p in rows:
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.LENGTH


def test_stages_but_the_last_return_documents(spark, tables, tmp_path):
    docs, items = tables
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(docs[:12], SCHEMA)
    for _, step in corpus_pipeline.STAGES[:-1]:
        for df in (empty, some):
            out = step(spark, df, str(tmp_path))
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert step(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_one_row_stays_of_repeated_ones(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(2, long), (1, long), (1, long), (5, "other text"), (5, "other text"), (5, "a third"), (None, "no id"), (None, "no id"), (None, "another"), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, long), (5, "a third"), (None, "no id"), (None, "another"), (7, None)], key=str)
