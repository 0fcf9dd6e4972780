"""Cases of the review: what a query left out, compared with plain sums or brute force."""

import numpy as np

SF = "/root/testdata/sf0.001"


def test_likelihood_holds_the_failure_term(spark):
    from polymix.plans.registry import QUERIES
    from polymix.sources.adapter import Domain

    d = Domain(spark, SF)
    y = {r.ind_id: r.y for r in d.phenotype().collect()}
    ind = sorted(y)
    fail = {r.ind_id: r.fail for r in d.failure().collect()}
    at, f = {x: i for i, x in enumerate(ind)}, np.array([fail[i] for i in ind], float)
    dosage, missing = {}, {}
    for r in d.genotype().collect():
        dosage.setdefault(r.marker_id, np.zeros(len(ind)))[at[r.ind_id]] = r.d or 0
        missing[r.marker_id] = missing.get(r.marker_id, 0) + (r.d is None)
    got = {r.marker_id: (r.log_like_1, r.log_like_2) for r in QUERIES["gh_marginal_likelihood"](spark, SF).collect()}
    eps, (nodes, weights) = np.array([y[i] for i in ind]), np.polynomial.hermite.hermgauss(5)
    v, moved = np.exp(0.8 * eps - 0.57721566490153286), 0
    for marker, (one, two) in got.items():
        x, n = dosage[marker], len(ind)
        m = x.sum() / (n - missing[marker])
        s = np.sqrt((((x - m) ** 2).sum() - missing[marker] * m * m) / (n - 1))
        x = (x - m) / s  # a missing cell counts as zero in both sums, as in the kernel
        moved += abs(x @ f) > 0.01
        for c, have in ((0.001, one), (0.01, two)):
            e = (v[dosage[marker] == 1].sum() * (1 - 2 * m) + 4 * (1 - m) * v[dosage[marker] == 2].sum() + m * m * v.sum()) / (s * s)
            t = nodes / np.sqrt(1 + 0.64 * 0.5 * c * e)
            beta = t * np.sqrt(2 * c * 0.5)
            logs = -0.8 * beta * (x @ f) + v.sum() - (np.exp(-0.8 * np.outer(beta, x)) @ v) - t * t
            want = np.log((weights * np.exp(nodes**2) * np.exp(logs)).sum() / np.sqrt(1 + 0.64 * 0.5 * c * e))
            assert abs(have - want) < 2e-6
    assert moved > len(got) // 2


def test_small_files_are_not_cut(spark, tmp_path):
    import pytest
    from polymix.sources import text

    (tmp_path / "m").write_text("1,2;\n" * 10_000)
    assert len(text.read_small(spark, f"file://{tmp_path}/m")) == 10_000
    (tmp_path / "m").write_text("1,2;\n" * 10_001)
    with pytest.raises(ValueError):
        text.read_small(spark, f"file://{tmp_path}/m")
