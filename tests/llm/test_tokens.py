import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from probity.llm.tokens import CachedEncoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {n: CachedEncoder(public_tokenizers.path(n), cache_words=50) for n in NAMES}
PARTS = st.sampled_from(
    ["the", "The", "of", "re.", "Sh.", "it's", "don't,", "...", "a,b", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "é", "́", "Éau,", "ß", "İ", "İ", "Σας", "ǅ", "ŉa", "ﬁ", "Straße", "ΟΔΟΣ.",
     "12", "3.14", "²", "Ⅷ.", " ", "　", " ", "漢字", "🙂", "***", "$$$", "<|endoftext|>", "'s", "'", "_", "\x00", "x\x1cy", "\x85", "ǆ,", "ʰ."]
)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(data=st.data())
def test_ids_are_those_of_the_whole_text(name, data):
    parts = data.draw(st.lists(st.one_of(PARTS, st.just(" "), st.text(max_size=4)), max_size=14))
    text = "".join(parts).encode("utf-8", "ignore").decode()
    encoder = ENCODERS[name]
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text])[0] == struct.pack(f"<{len(want)}I", *want)
