import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket string"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows, and columns of clashing names."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    lines = [text(12) for _ in range(40)]
    out = []
    for k in range(120):
        body = "\n".join([text(20), str(rng.choice(lines)), text(3), text(15)])
        out.append((k, body, "en" if k % 3 else "fr", f"s{k % 4}"))
    big = text(200).split()
    for k in range(120, 150):
        near = list(big)
        for j in rng.choice(200, int(rng.integers(0, 6)), replace=False):
            near[j] = "edit%d" % rng.integers(1000)
        out.append((k, " ".join(near), "en", None))
    out += [(150, None, None, "s0"), (151, "", "en", "s1"), (152, " \n\t ", None, "s1"), (153, "ONE Two", "en", "s9"), (154, "one two", "en", "s9"), (155, out[0][1], "en", "s2"), (156, text(6000), "fr", "s2"), (None, out[1][1], "en", "s3"), (None, None, None, None), out[5], (157, "..., 123 !", None, "s1"), (158, "a b c d e", "en", "s1"), (159, "A b c d E\nx", "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1]), 7, "x") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
