"""A label reaches every repeat of a token, however many there are."""

import numpy as np
import pytest

from caseloom.llm import pii


@pytest.mark.parametrize("repeats", [1, 5, 20, 200])
@pytest.mark.parametrize("odds", [0.0, -1.0, -3.0])
@pytest.mark.parametrize("place", [0, 0.5, 1])
def test_every_repeat_is_labelled(repeats, odds, place):
    at = int(place * repeats)
    text = " and then ".join("+49301234567" if i == at else "49301234567" for i in range(repeats + 1))
    # phone stands at the given odds against none after DOUBT, other labels far below
    unknown = np.array([0.0, -20.0, -20.0, -20.0, odds + pii.DOUBT])
    base, added = pii.all_spans(text, pii.Field({}, unknown, np.zeros((5, 5)), 6.0))
    assert [k for k, _, _ in base] == ["phone"] and len(added) == repeats and {k for k, _, _ in added} == {"phone"}
