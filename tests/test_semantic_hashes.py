"""Vectors are made by hashing all features of a text at once."""

import numpy as np

from loomrank.operators import semantic


def test_hashes_of_all_features_at_once():
    names = ["tok:a", "", "bg:ab cd", "tok:" + "z" * 500, "tok:" + "y" * 60, "skill:é", "tri:a.b"]
    for some in (names, names + ["skill:😀"], [], ["", ""]):
        one, two = semantic.hashes(some)
        assert one.tolist() == [semantic.fnv(x) for x in some] and two.tolist() == [semantic.fnv(x + "::2") for x in some]


def test_vector_sums_in_order():
    counts = semantic.features("Building the databases of the builders, and +c/x-y.z reading of " + "w" * 300 + " again and again " * 40, ["sql"])
    out = np.zeros(semantic.DIMS, np.float32)
    for x, n in counts.items():
        for h, share in ((semantic.fnv(x), 1.0), (semantic.fnv(x + "::2"), 0.5)):
            out[h % semantic.DIMS] += np.float32(n**0.5 * share if h & 1 else -(n**0.5) * share)
    assert np.array_equal(semantic.vector(counts), out / np.float32(np.sqrt((out.astype(np.float64) ** 2).sum())))
    assert not semantic.vector(semantic.features("")).any()
