"""The latent space against a dense decomposition."""

import numpy as np

from paperweave.operators import lsi


def test_singular_vectors_against_dense(spark):
    rng = np.random.default_rng(4)
    dense = (rng.random((40, 130)) < 0.1) * rng.random((40, 130))
    dense[:, :5] += 0.3
    cells = [("p", f"u{i:02}", f"t{j:03}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    postings = spark.createDataFrame(cells, "peer string, urn string, term string, weight double").repartition(3)
    ids = {r.term: r.id for r in lsi.numbered_terms(postings).collect()}
    assert ids == {t: i for i, t in enumerate(sorted(ids))}
    values, terms = lsi.singular_vectors(postings, 4)
    assert np.allclose(values, np.linalg.svd(dense, compute_uv=False)[:4])
    placed = lsi.documents_in_space(postings, terms, 4)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    low = (u[:, :4] * s[:4]) @ (u[:, :4] * s[:4]).T
    asked = postings.where("urn in ('u03', 'u17')").select("peer", "urn").distinct()
    got = {(r.urn_a, r.urn_b): r.sim for r in lsi.latent_similarities(placed, asked).collect()}
    assert len(got) == 2 * 39 and all(abs(x - low[int(a[1:]), int(b[1:])]) < 1e-6 for (a, b), x in got.items())
