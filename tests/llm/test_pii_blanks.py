"""White space belongs to no address."""

import pytest

from lodestone.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.trained()


@pytest.mark.parametrize("text", ["values 0.1 2.3 were seen", "0.1 2.3", "from 10.2 30.4 to 1.2 3.4 it went", "mail a@b c.org now"])
def test_numbers_apart_are_no_address(model, text):
    base = pii.base_spans(text)
    for kind, a, b in pii.added_spans(text, base, model):
        assert kind not in ("ip", "email") or " " not in text[a:b]


def test_phones_and_cards_may_hold_blanks(model):
    text = "call (212) 555-0147 now, card 4111 1111 1111 1111 it is"
    found = pii.base_spans(text) + pii.added_spans(text, pii.base_spans(text), model)
    assert {"card", "phone"} <= {k for k, _, _ in found}
