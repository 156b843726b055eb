import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathom.llm import token_counts as tc

RAW = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
SCHEMA = "doc_id bigint, source string, lang string, text string, n_tokens int"


def brute(text, bounds, rule):
    """Character by character, from the other library's offsets."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    count = [0.0] * (len(bounds) - 1)
    for a, b in tok.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(b, bounds[i + 1]) - max(a, bounds[i])) for i in range(len(count))]
        if rule == "start":
            count[next(i for i, s in enumerate(share) if s)] += 1
        elif rule == "majority":
            count[share.index(max(share))] += 1
        else:
            count = [c + s / sum(share) for c, s in zip(count, share)]
    return count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n🎉日 .'s1", max_size=30), min_size=1, max_size=3), st.sampled_from(tc.RULES))
def test_against_brute_force(values, rule):
    text, found = tc.sections([(str(i), v) for i, v in enumerate(values)])
    assert "".join(text[a:b] for _, _, a, b in found) == text
    bounds = [s[2] for s in found] + [found[-1][3]]
    if text:
        _, starts, ends = tc.spans(text, *tc.encoder(RAW, public_tokenizers.PATTERN))
        count, _ = tc.allot(starts, ends, np.array(bounds), rule)
        assert np.allclose(count, brute(text, bounds, rule))


def test_parts_encode_like_the_whole(monkeypatch):
    encode, lengths = tc.encoder(RAW, public_tokenizers.PATTERN)
    text = "Some words, and  more\n\nwords é in a row. " * 50
    whole = tc.spans(text, encode, lengths)
    monkeypatch.setattr(tc, "PART", 40)
    for a, b in zip(whole, tc.spans(text, encode, lengths)):
        assert np.array_equal(a, b)


def test_edges(spark):
    rows = [(1, "a", "en", "x\n\n\ny", 7), (1, "a", "en", "x\n\n\ny", 7), (None, None, None, None, None), (2, "", "", "", 0), (3, "s", "de", "wort " * 9000, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for rule in tc.RULES:
        got = tc.attribute(docs, rule=rule).collect()
        by = {}
        for r in got:
            by[r.doc_id] = by.get(r.doc_id, 0) + r.n_tokens
        assert by[None] == 1 or by[None] == 2  # the two joining newlines
        assert by[1] == 2 * sum(r.n_tokens for r in tc.attribute(docs.where("doc_id = 1").limit(1), rule=rule).collect())
    assert tc.attribute(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tc.attribute(docs, rule="other")
