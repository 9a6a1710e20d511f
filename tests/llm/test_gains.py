import math

import numpy as np

from tarnlight.llm.importance import gains


def test_each_side_is_smoothed_by_its_own_total():
    s, t = np.array([900, 60, 0, 40]), np.array([1, 6, 3, 0])
    want = [math.floor(1000 * math.log((b + 1) * (1000 + 4) / ((a + 1) * (10 + 4)))) for a, b in zip(s, t)]
    assert gains(s, t).tolist() == want
    assert gains(10 * s, 10 * s).tolist() == [0] * 4  # like shares gain nothing
    assert np.abs(gains(100 * s + 99, s)).max() < 1000  # nor do they on a smaller target


def test_a_table_against_the_contract(spark):
    import hashlib
    import re
    import zlib
    from collections import Counter

    from tarnlight.llm import queries

    sf = "/root/testdata/sf0.001"

    def runs(text: str | None) -> tuple[list[int], int]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)

    docs = {r.doc_id: runs(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    s = Counter(b for found, _ in docs.values() for b in found)
    t = Counter(b for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for b in runs(r.text)[0])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    want = {}
    for i, (found, _) in docs.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        want[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, (_, n) in docs.items() if n >= 20), key=lambda i: (-want[i][2], i))
    for place, i in enumerate(able[: 5 * len(able) // 100], 1):
        want[i][3] = place
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in queries.op11_importance(spark, sf).collect()} == want
