"""The stages of the corpus pipeline on small tables with nulls and repeats."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402


def prose(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_near_copies(spark):
    rng = random.Random(6)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    near = a + " more"
    repeats = [(1, b), (1, b), (2, a), (3, near), (3, c), (None, near), (None, d), (None, d), (7, d + " end"), (8, None), (9, "solo"), (None, e), (None, e)]
    plain = [(1, a), (2, near), (3, b), (4, None), (5, b + " end")]
    for rows in (repeats, plain):
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        docs = [(n, rows[i][1]) for n, i in enumerate(order)]
        groups = brute.components(docs)
        want = [rows[order[n]] for n, (_, least) in groups.items() if n == least]
        df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
        got = corpus_pipeline.near_copies(spark, df, "")
        assert got.columns == df.columns
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in got.collect())
    assert corpus_pipeline.near_copies(spark, df.limit(0), "").count() == 0


def test_benchmark_and_personal_data(spark, tmp_path):
    rng = random.Random(7)
    item = prose(rng, 30)
    spark.createDataFrame([("1", item), ("2", None), ("3", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    part = " ".join(item.split()[5:17])
    rows = [(1, prose(rng, 20)), (1, prose(rng, 9) + " " + part), (None, part), (None, prose(rng, 5)), (2, None), (3, ""), (4, "mail a.b@c.de or +1 (743) 555-3824"), (4, "mail a.b@c.de or +1 (743) 555-3824")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.benchmark(spark, df, str(tmp_path))
    want = [(i, t) for i, t in rows if not brute.decontaminated(t, {"1": item})[1]]
    assert kept.columns == df.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in kept.collect())
    clean = corpus_pipeline.personal_data(spark, df, "").collect()
    assert len(clean) == len(rows)
    assert sorted(str(r.text) for r in clean if r.doc_id != 4) == sorted(str(t) for i, t in rows if i != 4)
    assert not any(brute.base_spans(r.text) for r in clean) and sum("[EMAIL]" in (r.text or "") for r in clean) == 2


def test_whole_run(spark, tmp_path):
    """run() against plain code stage after stage: compression by hand, sets of shingles, windows, patterns, and the mix's own SQL."""
    import duckdb
    import pandas as pd
    import zstandard
    from pyspark.sql import functions as F

    from framewright.llm import langid, sql

    rng = random.Random(11)
    sounds = {"aa": "bal dor kem nu ra".split(), "bb": "ichi toka sumi reno".split(), "cc": "ploux que vrai tion".split()}
    speak = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    item = speak("aa", 30)
    rows = []
    for i in range(60):
        lang = "abc"[i % 3] * 2
        rows.append((i, speak(lang, 20 + 7 * (i % 9)), lang if i % 10 else None, f"s{i % 4}" if i % 5 else None))
    rows += [(100, rows[4][1], "bb", "s1"), (101, rows[6][1] + " more", "aa", "s2"), (102, None, "aa", "s0"), (103, "12 34", "aa", "s0"), (104, "", None, None)]
    rows += [(105, rows[3][1][:40] + " " + " ".join(item.split()[3:16]), "aa", "s1"), (106, speak("bb", 30) + " mail x.y@z.org now", "bb", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    (model,) = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))

    def told(text):
        data = langid._letters(text or "").strip().encode()
        if not any(map(str.isalpha, data.decode())):
            return False
        sizes = []
        for content in model.dictionaries.values():
            d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(len(coder.compress(data)))
        return 1 - sorted(sizes)[0] / sorted(sizes)[1] >= langid.MIN_MARGIN

    left = [r for r in rows if told(r[1])]
    assert 3 <= len(rows) - len(left) <= 5
    groups = brute.components([r[:2] for r in left])
    left = [r for r in left if groups[r[0]][1] == r[0]]
    left = [r for r in left if not brute.decontaminated(r[1], {"i": item})[1]]
    assert {100, 101, 105}.isdisjoint(r[0] for r in left)
    left = [(r[0], r[1].replace("x.y@z.org", "[EMAIL]"), *r[2:]) for r in left]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(left, columns=["doc_id", "text", "lang", "source"]))
    mixed = con.sql(sql.MIX).df()
    want = sorted((r.doc_id, int(s)) for r in mixed.itertuples() for s in r.shards.split(",") if s)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.shard) for r in got) == want and len(want) >= len(left) / 2
    texts = {r[0]: r for r in left}
    assert all((r.text, r.lang, r.source, r.n_chars) == (*texts[r.doc_id][1:4], len(r.text)) for r in got)
