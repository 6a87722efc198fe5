"""The pipeline's stages, each against plain Python on what the stage before kept."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "item_id long, text string"
VOCAB = [f"{a}{b}" for a in ("north", "river", "stone", "light", "wood", "glass", "paper", "field") for b in ("er", "ing", "ly", "", "s", "ed", "ful")]


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(VOCAB, int(n))) for n in r.integers(1, 150, 40)]
    texts += [t + " tail" for t in texts[::4]] + texts[:5] + [None, "", "12 34", "½ ²", texts[3] * 200]
    items = [" ".join(words(texts[7])[5:40]), "alone here", None]
    texts += ["before " + items[0] + " after", "It is Alone  here."]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[9], "en", "a", 1), rows[9], (11, texts[30], "en", "a", 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), BENCH).write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_every_stage_against_plain_python(spark, tables, tmp_path):
    folder, items = tables
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
    first = spark.read.parquet(f"{folder}/documents.parquet").collect()
    spoken, apart, clean, mixed, digest = kept
    assert {x for x in first if any(c.isalpha() for c in x.text or "")} >= set(spoken) and len(spoken) > 50

    def shingles(t):
        w = words(low(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    named = sorted({(x.doc_id, x.text) for x in spoken if x.doc_id is not None})
    sets, comp = [shingles(t) for _, t in named], list(range(len(named)))
    for _ in named:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert len({comp[named.index((x.doc_id, x.text))] for x in apart if x.doc_id is not None}) == len([x for x in apart if x.doc_id is not None]) == len(set(comp))
    assert all(x.doc_id == named[comp[named.index((x.doc_id, x.text))]][0] for x in apart if x.doc_id is not None)
    assert [x for x in apart if x.doc_id is None] == [x for x in spoken if x.doc_id is None]

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    def hit(t):
        w = split(t)
        return any(w[p : p + n] == x[a : a + n] for x in map(split, items) for n in [min(10, len(x))] for a in range(len(x) - n + 1 if n else 0) for p in range(len(w) - n + 1))

    assert sorted(clean, key=repr) == sorted((x for x in apart if not hit(x.text)), key=repr)
    size, most = {}, {}
    for x in clean:
        size[x.source] = size.get(x.source, 0) + len(words(x.text))
        most[x.doc_id] = most.get(x.doc_id, 0) + 3 * len(words(x.text))
    whole = {x.doc_id: "|".join(" ".join(words(y.text)) for y in clean if y.doc_id == x.doc_id) for x in clean}
    for x in mixed:
        most[x.doc_id] -= len(words(x.text))
        assert all(" ".join(words(part)) in whole[x.doc_id] for part in x.text.split("\n"))
    assert min(most.values()) >= 0 and abs(sum(len(words(x.text)) for x in mixed) - sum(size.values())) <= 64 * len(size)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc_id, text in sorted(((x.doc_id, x.text) for x in mixed), key=lambda x: (x[0] is not None, x[0], x[1].encode())):
        ids = [*coder.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((x.doc_id, x.n_tokens, x.ids_crc32) for x in digest), key=repr) == sorted(want, key=repr)
    assert sum(x.n_tokens for x in digest) == start and len({x.start for x in digest}) == len(digest)


def test_empty_tables_run_through(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
