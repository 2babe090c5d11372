"""Words on which polynomials modulo 2**64 collide for every base: operators 3 and 8 must tell them apart."""

import numpy as np

from graphloom.llm import minhash, segments, substring


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


X, Y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_such_words_collide_in_the_candidate_hash():
    data = np.frombuffer((X + Y).encode(), np.uint8)
    h = segments.slice_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] == h[1]


def test_windows_that_differ_in_such_a_word_stay(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{X} {rest} p"), (2, f"{Y} {rest} q")], "doc_id long, text string")
    assert {r.row.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicate(df).collect()} == {1: (36, 0), 2: (36, 0)}


def test_documents_of_such_words_are_not_linked(spark):
    df = spark.createDataFrame([(1, f"{X} k l m"), (2, f"{Y} k l m"), (3, X), (4, Y), (5, X)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_sequence_hashes_tell_sequences_by_order_and_length():
    leaves = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    for n in (1, 2, 3, 5, 35, 64, 300, 301):
        h = segments.sequence_hashes(leaves, n)
        assert len(h) == max(0, 301 - n) and len(np.unique(h)) == len(h)
        assert (segments.sequence_hashes(np.concatenate([leaves[7:], leaves]), n)[293:] == h).all()
    assert segments.sequence_hashes(leaves[:2], 2)[0] != segments.sequence_hashes(leaves[1::-1], 2)[0]
