"""Near-duplicate vectors: how often a vector is sent, and links across tasks, by brute force."""

import numpy as np

from tapeline.llm import embedding_dedup


def sent(spark):
    """Rows written to shuffles by the session so far."""
    none, store = spark._jvm.java.util.ArrayList(), spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_vector_is_sent_once_a_group(spark):
    """However many cells a vector is looked for in, and however many blocks those have. Half are one crowd, whose links go either way."""
    rng = np.random.default_rng(5)
    crowd, alone = rng.normal(size=16), rng.normal(size=(1000, 16))
    near = crowd / np.linalg.norm(crowd) + rng.normal(scale=0.065, size=(1000, 16))
    x = np.concatenate((near, alone)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    before = sent(spark)
    got = embedding_dedup.embedding_groups(df, 0.93, cell_rows=64, margin=0.6, block_rows=64).collect()
    assert sent(spark) - before < 40 * len(x)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(linked.sum(axis=1)))
    root = np.arange(len(x))
    while True:
        least = np.minimum(root, np.where(linked, root, len(x)).min(axis=1))
        if (least == root).all():
            break
        root = least
    assert {r.vec_id: r.component_id for r in got} == dict(enumerate(root))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
