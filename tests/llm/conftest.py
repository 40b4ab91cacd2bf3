"""Small tables with every odd case: nulls in all columns, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

CLASHING = "shard slot size text_crc32 law grown_shard held_out score predicted start length ids doc_tokens sequence_id offset keep_id group_size kept text_sha256 n_tokens ids_crc32 ids_sha256 decoded_sha256 n_lines licenses whole_license n_words n_removed kept_text kept_sha256 fingerprint edited_fingerprint near_edited near_next component_id bin low cuts major minor part number file u v a b n level slice data bits form whole digest license runs top collapsed n_runs period exponent_milli runs_sha256 collapsed_sha256 placed_edited".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def odd_rows():
    r = random.Random(5)
    words = ["lorem", "Ipsum", "dolor,", "sit", "amet", "ça", "naïve", "42", "don't", "日本", "x" * 40, "!!!", "é"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(n))
    passage, long = prose(60), prose(9000)
    texts = [prose(30), None, "", prose(80), passage + " " + prose(20), prose(15) + "\n" + passage, long, long + " end", " \t\n ", "one", "one two", "Licensed under CC BY 4.0.\n" + prose(12), passage, passage, prose(200) + " " + prose(3) * 5]
    rows = [(k, t, "en", f"s{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    rows += [(20, texts[0], None, None, None), (20, texts[0], None, None, None), (None, "null id " + prose(25), None, None, 3), (None, "null id " + prose(25), "fr", None, None), (None, None, None, None, None), (21, texts[0].upper(), "en", "s0", 1), (22, passage, "x", "y", 2), (-5, prose(40), "en", "s1", 7)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Documents, with columns named as the operators name theirs."""
    rows = [(*x, *(f"{c}{k}" if k % 4 else None for c in CLASHING)) for k, x in enumerate(odd_rows())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    """400 documents of the driver's, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, id string, v string, n string, good string, vector string, cls string, h1 string, n_links string, component_id string"


def odd_vectors():
    """(vec_id, embedding, label): copies, near copies, ties, and all that can't be compared."""
    r = random.Random(11)
    one = lambda n=64: [r.gauss(0, 1) for _ in range(n)]
    near = lambda x, by: [a + r.gauss(0, by) for a in x]
    a, b, short = one(), one(), one(3)
    rows = [(k, one(), k % 3) for k in range(60)] + [(100 + k, near(a, 0.02 * k), k % 2) for k in range(24)]
    rows += [(200 + k, b, 1) for k in range(5)] + [(210, b, 0), (211, [-x for x in b], 1), (212, [4 * x for x in b], 1), (212, [4 * x for x in b], 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 64, 1), (303, [-0.0] * 64, 1), (304, [float("nan"), *a[1:]], 0), (305, [None, *a[1:]], 0), (306, [float("inf"), *a[1:]], 0), (307, a, None), (308, a, None)]
    rows += [(310, short, 1), (311, near(short, 0.01), 1), (312, [*short, *one(61)], 1), (313, [1e-3 * x for x in a], 0), (314, [1e4 * x for x in a], 0), (None, a, 0), (None, a, 0), (None, one(), 2), (315, [0.0, -0.0, *b[2:]], 1), (316, [-0.0, 0.0, *b[2:]], 1)]
    return rows


@pytest.fixture(scope="session")
def vectors(spark):
    n = len(VECTOR_SCHEMA.split(",")) - 3
    return spark.createDataFrame([(*x, *["x" if k % 3 else None] * n) for k, x in enumerate(odd_vectors())], VECTOR_SCHEMA).repartition(3)
