"""Grid joins and repulsion against all pairs."""

import numpy as np

from weftline.operators import layout


def test_repelled_equals_all_pairs_and_comes_to_rest(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random((60, 3)) * 0.8, 3)
    p[5], p[6] = p[4], [-0.05, -0.2, 0.0]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if ((p[i] - p[j]) ** 2).sum() < 0.04}
    assert near and {(r.a, r.b) for r in layout.near_pairs(df, 0.2).collect()} == near

    def sweep(q):
        push = np.zeros_like(q)
        for i in range(60):
            for j in range(60):
                d = np.linalg.norm(q[i] - q[j])
                if i != j and 1e-6 <= d < 0.2:
                    push[i] += (q[i] - q[j]) / d * (0.2 - d) / 2
        return q + push

    expected = sweep(sweep(p))
    assert np.allclose([tuple(r)[1:] for r in layout.repelled(df, 0.2, 2).orderBy("id").collect()], expected)
    few = df.where("id < 8 and id <> 5")
    rest = np.array([tuple(r)[1:] for r in layout.repelled(few, 0.3, 60).collect()])
    apart = [np.linalg.norm(a - b) for i, a in enumerate(rest) for b in rest[:i]]
    assert min(apart) > 0.3 - 1e-3
    assert layout.repelled(df.limit(0), 0.2, 3).count() == 0
