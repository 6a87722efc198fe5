import pytest
from sievewright.operators import relational as R


@pytest.mark.parametrize("indexed", [1 << 20, 0])
@pytest.mark.parametrize("least", [0.0, 0.3])
def test_similar_topk_equals_brute_force(spark, indexed, least):
    sets = [[f"k{j}" for j in range(60) if (i * 7 + j * j) % (i % 5 + 2) == 0] + ["all"] * 2 for i in range(24)] + [[], ["lone"]]
    rows = [(i, x) for i, x in enumerate(sets)]
    got = R.similar_topk(spark.createDataFrame(rows, "q long, keys array<string>"), spark.createDataFrame(rows[::2], "e long, keys array<string>"), 3, least, indexed).collect()
    want = []
    for q, x in rows:
        scored = [(len({*x} & {*y}) / len({*x} | {*y}), e) for e, y in rows[::2] if {*x} & {*y}]
        best = sorted(((-s, e) for s, e in scored if s >= least))[:3]
        want += [(q, e, -s, i + 1) for i, (s, e) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing_carries_its_open_request_from_one_fold_to_the_next(spark):
    costs = [(i * 7919) % 900 + (5000 if i % 97 == 0 else 0) for i in range(3 * R.FOLDED + 5)]
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate(costs)] + [("b", 1, 9)], "g string, i long, c long")
    got = [(r.request, list(r["items"]), r.payload) for r in R.packed(rows, ["g"], "i", "c", 2400, 6).where("g = 'a'").orderBy("request").collect()]
    want = []
    for i, c in enumerate(costs):
        if not want or len(want[-1][0]) >= 6 or want[-1][1] + c > 2400:
            want.append([[], 0])
        want[-1][0].append(i)
        want[-1][1] += c
    assert got == [(n, items, payload) for n, (items, payload) in enumerate(want)]
