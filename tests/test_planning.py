import random

from scriptorium.plans.planning import merge_small_sections


def merged(sections):
    while len(sections) > 4:
        k = min(range(len(sections) - 1), key=lambda i: sections[i][1] + sections[i + 1][1])
        a, b = sections[k : k + 2]
        sections[k : k + 2] = [(f"{a[0]} & {b[0]}", a[1] + b[1])]
    return sections


def test_merge_small_sections_of_long_conversations(spark, tmp_path):
    r = random.Random(4)
    rows = [(c, t, "user", "x" * r.randint(0, 40)) for c, n in enumerate((1, 3, 4, 5, 19, 20, 21, 22, 60, 300)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((x.conv_id, x.section, x.title, x.cited) for x in merge_small_sections(spark, str(tmp_path)).collect())
    plans = {c: merged([(f"S{t}", len(x) % 9) for d, t, _, x in rows if d == c]) for c in {x[0] for x in rows}}
    assert got == sorted((c, i, t, n) for c, p in plans.items() for i, (t, n) in enumerate(p))
