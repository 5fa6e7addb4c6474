"""Items too short for edits, and items in scripts without spaces."""

import numpy as np
import pytest

from tallyplan.llm import decontaminate as D

CHINESE = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u4e00\u8d77\u53bb\u516c\u56ed\u6563\u6b65\u5427"
ITEMS = ((1, "Who wrote Hamlet?"), (2, "pi"), (3, CHINESE), (4, "\u516c\u56ed"), (5, "internationalization responsibilities"))


@pytest.mark.parametrize(
    "text, ids",
    [
        ("so: who  wrote HAMLET", {1}), ("who wrote hamlets", set()), ("pi", {2}), ("is pi, it", {2}), ("pie api", set()), (CHINESE, {3, 4}), ("x " + CHINESE[:5] + "\u4e0d" + CHINESE[6:] + " y", {3, 4}),
        (CHINESE[:9], set()), ("\u53bb\u516c\u56ed", {4}), ("some internationalization responsibilities here", {5}), ("p", set()), ("", set()),
    ],
)
def test_short_items(text, ids):
    raw = [t.encode() for t in ("p", text, "i")]
    got = D.Items(ITEMS).leaks(*D.normalized(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])))
    items = D.Items(ITEMS).ids
    assert {(d, items[k]) for d, k in got} == {(1, i) for i in ids}
