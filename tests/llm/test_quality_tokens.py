"""Tokens of the quality classifier."""

import numpy as np

from tallyplan.llm import quality_classifier as Q


def ids(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return Q.tokens(raw, np.array([0, len(raw)]))[0].tolist()


def test_long_words_have_their_own_token_and_share_their_ending():
    a, b = ids("instrument"), ids("government")
    assert len(a) == len(b) == 2 and len(set(a) & set(b)) == 1
    assert len(ids("throughout the")) == 3 and ids("the") == ids("throughout the")[2:]
    assert len(set(ids("\u0433\u043e\u0440\u043e\u0434 \u043d\u0430\u0440\u043e\u0434"))) == 2  # one ending, two words


def test_scripts_without_spaces_are_read_whole():
    text = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u3002"
    assert len(ids(text)) == 11 + 10 + 1
    assert len(ids("\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35")) == 6 + 5
    assert set(ids(text)) != set(ids(text[4:]))
    assert len(ids("\U00020000\U00020001")) == 3 and len(ids("\U0001f600")) == 1


def test_tokens_stay_in_their_documents():
    parts = ["\u4eca\u5929", "", "\u5929\u6c14 a", "different", "\u597d"]
    raw = [p.encode() for p in parts]
    got, doc = Q.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert (np.diff(doc) >= 0).all() and [got[doc == k].tolist() for k in range(5)] == [ids(p) for p in parts]
