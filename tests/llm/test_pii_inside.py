"""Valid values inside or at the beginning of longer matches that aren't valid."""

import pytest

from estimark.llm import pii


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        ("paid 4111 1111 1111 1111 12/25 ok", "4111 1111 1111 1111", "card"),
        ("paid 4111 1111 1111 1111 123 ok", "4111 1111 1111 1111", "card"),
        ("paid 3782 822463 10005 2027 ok", "3782 822463 10005", "card"),
        ("row 12 4111 1111 1111 1111 ok", "4111 1111 1111 1111", "card"),
        ("to ES91 2100 0418 4502 0005 1332 1234 ok", "ES91 2100 0418 4502 0005 1332", "iban"),
        ("to BE68 5390 0754 7034 BANK ok", "BE68 5390 0754 7034", "iban"),
        ("to AT611904300234573201 2024 ok", "AT611904300234573201", "iban"),
        ("ref AB12 4111 1111 1111 1111 ok", "4111 1111 1111 1111", "card"),
    ],
)
def test_valid_part_is_replaced(text, value, kind):
    new, counts = pii.replace(text, b"k")
    before, after = text.split(value)
    assert value not in new and counts == {kind: 1}
    assert new.startswith(before) and new.endswith(after) and len(new) == len(text)
    assert pii.RULES[kind](b"k", new[len(before) : len(new) - len(after)]) is not None


def test_nothing_valid_stays():
    for text in ["4111 1111 1111 1112", "on 2024-02-30", "999.1.2.3", "ES91 2100 0418 4502 0005 1333", "000-12-3456"]:
        assert pii.replace(text, b"k") == (text, {})
