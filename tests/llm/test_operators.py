"""Small fixtures with nulls, ties, empty and clashing columns, against brute force."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sievewright.llm import chat, decontaminate, graph, jaccard, langid, lm, mixing, shared, sharding, tokenids, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, hits string, score string"
rng = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(300)]


def base():
    texts = [" ".join(rng.choice(VOCAB, n)) for n in (1, 3, 4, 12, 60, 200, 900)]
    near = [" ".join(t.split()[:-1] + ["x"]) for t in texts[3:]]
    odd = [None, "", " \n ", "ÄÖ ß", "<|endoftext|> a\x85b", texts[4].upper()]
    every = texts + near + odd + [texts[5], texts[5]]
    return [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], "h", "s") for i, t in enumerate(every)] + [(None, texts[5], "en", "a", "h", "s"), (3, every[3], "en", "a", "h", "s")]


@pytest.fixture(scope="module")
def rows():
    return base()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.fixture(params=["full", "empty"])
def docs(request, spark, rows):
    return spark.createDataFrame(rows if request.param == "full" else [], DOCS)


def test_jaccard_equals_brute_force(spark, rows):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()

    every = [(r[0], shingles(r[1])) for r in rows]
    comp = {i: i for i, _ in every if i is not None}
    for _ in every:
        for a, x in every:
            for b, y in every:
                if None not in (a, b) and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    want = sorted(((i, len(s), comp.get(i)) for i, s in every), key=repr)
    for block in (3000, 2):
        got = jaccard.joined(spark.createDataFrame(rows, DOCS), block=block).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_jaccard_with_a_common_passage_equals_brute_force(spark):
    r = np.random.default_rng(11)
    passage = " ".join(r.choice(VOCAB, 40))
    texts = [passage + " " + " ".join(r.choice(VOCAB, int(n))) for n in r.integers(5, 120, 30)]
    texts += [t + " tail" for t in texts[::3]]
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) for w in map(words, texts)]
    comp = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 85 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = jaccard.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=2).collect()
    assert sorted(map(tuple, got)) == [(i, len(x), comp[i]) for i, x in enumerate(sets)]


@pytest.mark.parametrize("local", [1 << 20, 3])
def test_components_in_one_task_or_by_rounds(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(900 + i, 901 + i) for i in range(9)] + [(5, 5)]
    root = list(range(1000))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root[x]) for x in nodes)


def test_workers_hold_one_operators_cache(spark):
    def job(name, keeps):
        def work(batches):
            for b in batches:
                shared.held(name, object)
                yield pa.RecordBatch.from_arrays([pa.array([",".join(sorted(shared._held))])], names=["names"])

        return {r.names for r in shared.in_arrow(spark.range(0, 8, 1, 2), work, "names string", keeps).collect()}

    assert job("a", "a") == job("a", "a") == {"a"} and job("b", "b") == {"b"} and job("c", "") == {"c"}


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    for df in (jaccard.joined(none), langid.digest(none), tokenids.read(tokenids.written(none, "word_bpe_49k.json")), mixing.digest(none), sharding.sharded(none)):
        assert df.collect() == []
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert lm.scored(none.withColumn("train", none.doc_id > 0), "train").collect() == []


def test_token_ids_read_back(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenids.read(tokenids.written(spark.createDataFrame(rows, DOCS), "word_bpe_49k.json", chunk=50)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("ranks", [65_535, 3])
def test_simple8b_round_trip(ranks):
    for n in (0, 1, 239, 240, 241, 5000):
        ids = np.minimum(rng.zipf(1.2, n), 2**32 - 1).astype(np.uint32)
        table, _, payload = tokenids.pack(ids, ranks)
        assert (tokenids.unpack(table, payload) == ids).all()


def test_simple8b_counts_and_sorts_give_one_form(monkeypatch):
    ids = (rng.zipf(1.2, 5000) % 50_000).astype(np.uint32)
    counted = tokenids.pack(ids, 300)
    monkeypatch.setattr(tokenids, "DENSE", 0)
    assert all((x == y).all() for x, y in zip(counted, tokenids.pack(ids, 300), strict=True))


def test_sharding_is_even_and_keeps_equal_texts(spark, rows):
    got = sharding.sharded(spark.createDataFrame(rows, DOCS), shards=3).collect()
    assert len(got) == len(rows)
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("loose", [400, 10])
def test_sharding_splits_only_groups_that_fit_no_shard(spark, loose):
    """A hot group above the quota fills whole shards; with few unlinked bytes at most one group a border is split."""
    r = np.random.default_rng(7)
    texts = ["hot " * 10] * 400 + [t for i in range(150) for t in [f"group {i} " + "x" * int(r.integers(5, 60))] * int(r.integers(2, 9))]
    texts += [f"alone {i} " + "y" * int(r.integers(5, 60)) for i in range(loose)]
    got = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=6).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(texts)))
    on, load = {}, [0] * 6
    for x in got:
        on.setdefault(texts[x.doc_id], []).append(x.shard)
        load[x.shard] += x["size"]
    quota, hot = sum(load) / 6, on["hot " * 10]
    split = sum(len(set(s)) > 1 for t, s in on.items() if t != texts[0])
    assert max(load) - min(load) < 200 and split <= (0 if loose == 400 else 5), split
    assert sorted(map(hot.count, set(hot)))[1:] == [quota // 48] * int(len(hot) // (quota // 48))


def test_mix_takes_near_targets(spark, rows):
    got = mixing.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(t) - target) <= 64 for target, t in by.items())


def test_mix_equals_a_plain_count_of_its_draws(spark, rows):
    """taken against every word of every drawn block, one by one; the mixed texts against taken; reruns agree."""
    docs = spark.createDataFrame(rows * 3 + [(i, rows[6][1], "en", s, "h", "s") for i, s in ((1, "b"), (1, "a"), (2, "b"), (2, "b"))], DOCS)
    table, draws = mixing.planned(docs, 16, 8)
    plan, drawn = table.collect(), draws.collect()
    assert sorted((r.shard, r.slot) for r in drawn) == [(i // 8, i % 8) for i in range(len(drawn))]
    runs = {}
    for r in sorted(plan, key=lambda r: (r.src, r.ord)):
        runs.setdefault(r.src, []).extend([(r.src, r.ord)] * r["size"])
    taken = {}
    for d in drawn:
        for who in runs[d.src][d.block * 16 : d.block * 16 + 16]:
            taken[who] = taken.get(who, 0) + 1
    got = {(r.src, r.ord): sum(p.n * p.times for p in r.p) for r in mixing.pieces(table, draws, 16).groupBy("src", "ord").agg(F.collect_list(F.struct("n", "times")).alias("p")).collect()}
    assert got == taken and all(n <= 3 * r["size"] for r in plan for n in [taken.get((r.src, r.ord), 0)])
    for src, run in runs.items():
        target = next(r.target for r in plan if r.src == src)
        assert abs(sum(n for (s, _), n in taken.items() if s == src) - target) <= 16
    digest = mixing.digest(docs).collect()
    assert sorted(digest, key=repr) == sorted(mixing.digest(docs).collect(), key=repr)
    mixed = mixing.mixed(docs).collect()
    by_row = lambda rs, n: sorted((repr(k), sum(x[1] for x in g)) for k, g in itertools.groupby(sorted(((r.doc_id, n(r)) for r in rs), key=repr), lambda x: x[0]))
    assert by_row([r for r in digest if r.taken], lambda r: r.taken) == by_row(mixed, lambda r: len(words(r.text)))


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([10, 1000, 0], [5, 2, 1]) == [30.0, 980.0, 0.0]


def test_permutation_is_one():
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_language_model_base_and_score(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    got = lm.scored(docs.withColumn("train", langid.fold("doc_id", 7) != 2), "train").collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) and r.score < 0 for r in got)
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    counts = {}
    for r in train:
        for w in words(r[1]):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = {r[0]: sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words(r[1])) + np.log10((len(train) + 1) / (n + v + 1)) for r in rows}
    assert all(r.train_tokens == n and abs(r.base_score - want[r.doc_id]) < 1e-6 for r in got)


@pytest.mark.parametrize("order", range(8))
def test_language_model_runs_read_each_symbol_once(order, monkeypatch):
    """Byte by byte over plain texts; bytes are gathered once a run, not once for each byte of it."""
    texts, gathered, symbols = ["", "a", "Zwölf é", "abcabcabcabc" * 3, ""], [], lm.symbols

    class Counted(np.ndarray):
        def __getitem__(self, at):
            gathered.append(isinstance(at, np.ndarray))
            return super().__getitem__(at)

    def counted(w, n):
        text, at = symbols(w, n)
        return text.view(Counted), at

    monkeypatch.setattr(lm, "symbols", counted)
    for values in ([], texts):
        for w in lm.W.texts(pa.array(values, pa.string())):
            got = np.asarray(lm.runs(w, order)).tolist()
            coded = [[0xFE] * order + list(re.sub("[A-Z]+", lambda m: m[0].lower(), t).encode()) + [0xFF] for t in values]
            assert got == [sum(t[i - j] << 8 * j for j in range(order + 1)) for t in coded for i in range(order, len(t))]
    assert sum(gathered) <= 1


@pytest.mark.parametrize(("order", "share"), [(3, 1024), (6, 0), (6, 40), (6, 1 << 30), (7, 1024)])
def test_language_model_score_equals_brute_force(spark, rows, order, share):
    """Symbol by symbol over plain dictionaries, with the excluded symbols as a set; no, some or all contexts frequent."""
    docs = spark.createDataFrame(rows, DOCS)
    got = lm.scored(docs.withColumn("train", langid.fold("doc_id", 7) != 2), "train", order, share).collect()
    seen = {}
    coded = {r[1]: [0xFE] * order + list(re.sub("[A-Z]+", lambda m: m[0].lower(), r[1] or "").encode()) + [0xFF] for r in rows}
    for r in rows:
        text = coded[r[1]]
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            for i in range(order, len(text)):
                for j in range(order + 1):
                    counts = seen.setdefault(tuple(text[i - j : i]), {})
                    counts[text[i]] = counts.get(text[i], 0) + 1

    def cost(text):
        total = 0.0
        for i in range(order, len(text)):
            out, p = set(), 1.0
            for j in range(order, -1, -1):
                left = {s: c for s, c in seen.get(tuple(text[i - j : i]), {}).items() if s not in out}
                if not left:
                    continue
                if text[i] in left:
                    p *= (2 * left[text[i]] - 1) / (2 * sum(left.values()))
                    break
                p *= len(left) / (2 * sum(left.values()))
                out |= set(left)
            else:
                p /= 257 - len(out)
            total += np.log10(p)
        return total

    want = {text: cost(symbols) for text, symbols in coded.items()}
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(want[r[1]])
    for r in got:
        assert min(abs(r.score / x - 1) for x in by_id[r.doc_id]) < 1e-6


LETTERLESS = [(700 + i, t, "en", "a", "h", "s") for i, t in enumerate(["½ ² Ⅷ", "一" * 0 + "12_3", "\u0301 ٣", "— …"])]


def letters(text):
    """Words of letters, found character by character."""
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")


def test_language_id_equals_brute_force(spark, rows):
    """Counts and back-off written out by string slices; a tie goes to the first language; very long and repeated rows."""
    tie = [(800 + i, t, lang, "a", "h", "s") for i, (t, lang) in enumerate([("zzz zzz", "de"), ("zzz zzz", "en"), ("zzz", None), (rows[6][1] * 300, "en")])]
    every = rows + LETTERLESS + tie
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    train = {(r[0], r[1], r[2]) for r in every if fold(r[0]) and r[1] is not None and r[2] is not None}
    train = sorted({(lang, text) for _, text, lang in train})
    langs = sorted({lang for lang, _ in train})
    words_, grams = {}, {}
    for lang, text in train:
        for w in filter(None, letters(text)):
            words_.setdefault(w, [0] * len(langs))[langs.index(lang)] += 1
    for w, counts in words_.items():
        for g in range(1, 5):
            for i in range(len(w) + 3 - g):
                own = grams.setdefault(g, {}).setdefault(f" {w} "[i : i + g], [0] * len(langs))
                for k, c in enumerate(counts):
                    own[k] += c
    logs = lambda c, table: [np.log((x + 0.5) / (max(1, sum(t[k] for t in table.values())) + 0.5 * len(table))) for k, x in enumerate(c)]

    def score(w):
        if sum(words_.get(w, [0])) >= 2:
            return np.array(logs(words_[w], words_))
        total, rest = np.zeros(len(langs)), f" {w} "
        while rest:
            g = next((g for g in (4, 3, 2, 1) if g <= len(rest) and rest[:g] in grams.get(g, {})), 1)
            if rest[:g] in grams.get(g, {}):
                total = total + np.array(logs(grams[g][rest[:g]], grams[g])) / 4
            rest = rest[max(1, g - 1) :]
        return total

    memo = {}
    want = []
    for r in every:
        found = [w for w in letters(r[1]) if w]
        total = sum((memo.setdefault(w, None) if memo.get(w) is not None else memo.__setitem__(w, score(w)) or memo[w] for w in found), np.zeros(len(langs)))
        best = int(np.argmax(total))
        p = np.exp((total - total[best]) * min(1, 20 / max(1, len(found))))
        want.append((r[0], fold(r[0]) == 0, langs[best] if found else "und", round(1 / p.sum(), 6) if found else 0.0))
    got = langid.digest(spark.createDataFrame(every, DOCS)).collect()
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.lang_pred == "und" for r in got if r.doc_id is not None and 700 <= r.doc_id < 800)


def test_language_sample_is_dealt_over_languages(spark):
    rows = [(i, f"text {i}", "en", "a", "h", "s") for i in range(3000)] + [(5000 + i, f"selten {i}", "xx", "a", "h", "s") for i in range(20)]
    rows += [(None, "again", "en", "a", "h", "s")] * 500
    got = [r.lang for r in langid.sampled(spark.createDataFrame(rows, DOCS), langid.fold("doc_id", 5) >= 0, 100).collect()]
    assert got.count("xx") == 20 and 20 <= got.count("en") <= 90


def test_stages_keep_columns_whose_names_clash(spark, docs):
    """Full and empty tables, with columns named like an operator's own; a column of another kind comes through."""
    clash = docs.select("*", F.lit(7).alias("n_words"), F.lit("x").alias("items"), F.lit(1.5).alias("lang_pred"), F.array(F.lit(1)).alias("_row"), F.lit(True).alias("_maybe"), F.lit(2).alias("size"), F.lit(3).alias("name"))
    items = spark.createDataFrame([(1, "no such words at all")], "item_id long, text string")
    for kept in (langid.accepted(clash, least=0.0), jaccard.representatives(clash), decontaminate.clean(clash, items), mixing.mixed(clash)):
        assert kept.columns == clash.columns
        assert all((r.n_words, r["items"], r.lang_pred, list(r._row), r._maybe, r.size, r["name"]) == (7, "x", 1.5, [1], True, 2, 3) for r in kept.collect())
    for judged in (mixing.digest(clash), sharding.sharded(clash), langid.digest(clash), jaccard.joined(clash)):
        assert judged.count() == docs.count()


@pytest.mark.parametrize("block_words", [400_000, 12])
def test_decontamination_equals_brute_force(spark, rows, block_words):
    items = [(1, " ".join(rows[5][1].split()[20:45])), (2, "ÄÖ ß"), (10, None), (None, rows[4][1]), (3, "zz"), (3, rows[3][1])]
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    for r in got:
        w, hit, found = split(r.text), set(), set()
        for i, t in items:
            x = split(t)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        hit.update(range(p, p + n))
                        found.add("" if i is None else str(i))
        assert (r.n_words, sorted(r.hits), r["items"]) == (len(w), sorted(hit), sorted(found))


def test_urls(spark):
    want = {
        "HTTP://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/x": ("example.net", "/x", "net/", "block"),
        "http://xnet/#a": ("xnet", "/", None, "allow"),
        "http://a/casino": ("a", "/casino", None, "block"),
        "http://a/casinos": ("a", "/casinos", None, "allow"),
        "http://a/free-free": ("a", "/free-free", None, "allow"),
        "http://a/FREE-bet": ("a", "/FREE-bet", None, "block"),
        "ftp://a.org/fr/ ://b/casino": ("a.org", "/fr/ ://b/casino", "org/fr/", "allow"),
        "a/casino": ("", "", None, "block"),
        "http://?casino": ("", "", None, "block"),
        "http://Ä.net/ü?": ("Ä.net", "/ü", "net/", "block"),
        "http://a/" + "x/" * 50_000 + "casino": ("a", "/" + "x/" * 50_000 + "casino", None, "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "mine", None) for i, u in enumerate([*want, *want])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = sorted(map(tuple, urls.judged(pages).collect()))
    assert got == [(i, *want[u]) for i, u, *_ in rows]
    assert {r.verdict for r in urls.judged(pages, [], {}).collect()} == {"allow"} and urls.judged(pages.limit(0)).collect() == []


def test_chat_round_trip(spark):
    odd = "a<|b|>\\<s>[INST]<<SYS>>\\</s><|>"
    assert chat.unescape(chat.escape(odd)) == odd and not any(c in chat.escape(odd) for c in chat.CONTROLS)
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (2, 0, "user", "hi"), (2, 1, "assistant", None), (None, None, None, "x"), (1, 2, "assistant", "ß")]
    packs = chat.packs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), n=1)
    assert sum(r.text.count("hi") for r in packs.collect()) == 1
    got = {r.conv_id: r for r in chat.read(packs).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].n_turns) == (3, len(odd) + 1, 0, 1)


@pytest.mark.parametrize("block", [512, 2])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    center = rng.standard_normal((20, 64))
    v = np.repeat(center, 8, axis=0) + rng.standard_normal((160, 64)) * 0.25
    v[5] = v[4]
    rows = [(i, x.tolist(), int(i % 3 == 0)) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 0), (903, v[4].tolist(), None), (None, v[4].tolist(), 0)]
    got = {r.vec_id: r for r in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()}
    f = v.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    label = np.arange(160) % 3 == 0
    links = (f @ f.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(160, dtype=bool)
    found = sum(got[i].n_links for i in range(160))
    assert found >= 0.99 * links.sum() and all(got[i].n_links <= links[i].sum() for i in range(160))
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_links_near_the_bound_and_text_labels(spark):
    """Pairs a little above cosine 0.93 in 64 dimensions, labels as text, repeated rows, other columns."""
    r, rows = np.random.default_rng(21), []
    for i in range(300):
        a, b = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        cos = 0.935 if i % 2 else 0.925
        rows += [(2 * i, a.tolist(), "x", 1), (2 * i + 1, (cos * a + np.sqrt(1 - cos * cos) * b).tolist(), "x", 1)]
    rows += [rows[0], (2000, rows[0][1], "y", 1), (2001, rows[0][1], None, 1)]
    got = vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, kept int")).collect()
    links = {}
    for x in got:
        links.setdefault(x.vec_id, []).append(x.n_links)
    assert sum(sum(links[2 * i + 1]) for i in range(1, 300, 2)) >= 0.97 * 150 and not any(sum(links[2 * i + 1]) for i in range(2, 300, 2))
    assert links[0] == [1, 1] and links[2000] == links[2001] == [0]


def test_short_vectors_are_found(spark):
    r, rows, want = np.random.default_rng(13), [], {}
    for d in (2, 3, 4, 6):
        v = r.standard_normal((250, d)).astype(np.float32).astype(float)
        rows += [(1000 * d + i, x.tolist(), 0) for i, x in enumerate(v)]
        f = v / np.linalg.norm(v, axis=1, keepdims=True)
        want[d] = (f @ f.T >= 0.93).sum() - 250
    got = vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    recall = {d: sum(x.n_links for x in got if x.vec_id // 1000 == d) / want[d] for d in want}
    assert all(0.97 <= x <= 1 for x in recall.values()), recall
