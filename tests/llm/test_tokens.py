"""Word memory against whole texts, other tokenizers, and ranges read through the block index."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from graphloom.llm import tokens
from graphloom.llm.queries import vocabulary

ODD = [
    "Don't STOP, it's 12,5% off!!", "İstanbul Straße été ﬁn", "<|endoftext|> a<|STARTOFTEXT|>b <|startoftext|>", "x y z\x1fq", "日本語。テスト हिन्दी العربية",
    "a" * 5000 + "." * 300, "'''s 's ' '", "", None, "A.B.C. __init__ foo_bar... (x)", "١٢٣ Ⅷ ½ x²",
]


def test_words_give_the_ids_of_whole_texts():
    encoder = tokens.WordEncoder(vocabulary(), size=3)
    for texts in (ODD, ODD[3:], [t for t in ODD if t and "<|" not in t]):
        ids, counts = encoder(pa.array(["skipped", *texts]).slice(1))
        cuts = np.cumsum(counts)
        for t, a, b in zip(texts, cuts - counts, cuts, strict=True):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert len(encoder.young) + len(encoder.old) < 150


def test_other_tokenizers_encode_whole_texts():
    encoder = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_words
    ids, counts = encoder(pa.array(["Hello  World, again", None]))
    assert ids.tolist() == encoder.tokenizer.encode("Hello  World, again", add_special_tokens=False).ids and counts[1] == 0


def test_a_range_of_ids_is_read_alone(tmp_path):
    ids = np.random.default_rng(2).integers(0, 60_000, 3 * tokens.BLOCK + 17, dtype=np.uint32)
    (tmp_path / "x.pfor").write_bytes(tokens.encode_file([1], [len(ids)], ids))
    for a, b in ((0, 1), (1023, 1025), (2000, 3089), (5, 5), (3080, 10**9)):
        assert (tokens.read_range(f"file://{tmp_path}", "x.pfor", a, b) == ids[a:b]).all()
