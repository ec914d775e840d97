from collections import defaultdict

from gatehouse.llm import mixing


def check(rows, block, weights=None):
    rows = sorted(rows, key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows)))
    blocks = sorted({(r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in rows}, key=lambda b: b[0])
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    assert all(b[3] <= b[0] < b[4] for b in blocks)
    number = defaultdict(int)
    for _, source, k, _, _ in blocks:
        assert k == number[source]
        number[source] += 1
    return blocks


def test_every_block_is_in_its_window_and_all_rows_are_kept(spark):
    sizes = {"a": 700, "b": 150, "c": 149, "d": 5, None: 31}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(k, f"text {k}", s) for k, (_, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(df, block=8, period=64).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    check(got, 8)


def test_less_than_one_block_from_target_in_every_prefix(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN 'x' ELSE 'y' END AS source")
    weights = {"x": 1.0, "y": 3.0}
    blocks = check(mixing.mix(df, weights, block=4, period=64).collect(), 4)
    done, last_y = 0, max(b[0] for b in blocks if b[1] == "y")
    for n, b in enumerate(blocks[: last_y + 1], 1):
        done += b[1] == "y"
        assert abs(done - 0.75 * n) < 1


def test_the_schedule_is_earliest_deadline_first(spark):
    q = {"a": 5, "b": 3, "c": 2}
    sizes = spark.createDataFrame([(f"={k}", v * 4) for k, v in q.items()], "key string, n long")
    got = {r["slot"]: r["key"] for r in mixing.schedule(sizes, {k: v / 10 for k, v in q.items()}, block=1, period=10).collect()}
    done, want = dict.fromkeys(q, 0), []
    for t in range(40):
        ready = [(-(-(done[k] + 1) * 10 // w), i, k) for i, (k, w) in enumerate(q.items()) if done[k] * 10 // w <= t]
        k = min(ready)[2]
        done[k] += 1
        want.append(f"={k}")
    assert [got[t] for t in range(40)] == want


def test_mixed_keeps_rows_and_columns(spark, docs, odd):
    out = mixing.mixed(docs, block=4)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert sorted(map(str, mixing.mixed(odd).collect())) == sorted(map(str, odd.collect()))
    assert mixing.mix(odd.where("false")).count() == 0
    ordered = [r["doc_id"] for r in out.collect()]
    place = {r["doc_id"]: r["position"] for r in mixing.mix(docs, block=4).collect()}
    assert [place[i] for i in ordered] == sorted(place.values())


def test_different_rows_with_one_64_bit_hash_are_both_kept(spark):
    p1, p2, p5, mask = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, 2**64 - 1
    rotl = lambda x, r: ((x << r) | (x >> (64 - r))) & mask
    seeds = [r["h"] & mask for r in spark.range(1, 3).selectExpr("xxhash64(id) AS h").collect()]
    into = [(s + p5 + 8) & mask for s in seeds]
    lane = into[0] ^ (rotl(5 * p2 & mask, 31) * p1 & mask) ^ into[1]  # what the second row must mix in to end where the first does
    other = rotl(lane * pow(p1, -1, 1 << 64) & mask, 33) * pow(p2, -1, 1 << 64) & mask
    rows = [(1, 5, None), (2, other - (1 << 64) if other >> 63 else other, None), (3, 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, x long, source string")
    assert df.selectExpr("xxhash64(doc_id, x, source) AS h").distinct().count() == 2
    assert sorted(map(tuple, mixing.mixed(df).collect())) == rows
