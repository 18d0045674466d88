"""Mentions of a person without a title."""

import re

from lumenframe.llm import pii


def test_pii_names_without_a_title():
    text = "Smith came. Mr. John Smith called. John Smith said so, SMITH left, Smith's hat; Smithson and blacksmith stay."
    out, kinds = pii.replace(text, b"key", {})
    assert not re.search(r"\b(John|Smith|SMITH)\b", out) and out.endswith("Smithson and blacksmith stay.")
    given, family = re.search(r"Mr\. (\w+) (\w+) called", out).groups()
    assert out.startswith(f"{family} came.") and f"called. {given} {family} said so, {family.upper()} left, {family}'s hat" in out
    assert sorted(kinds) == ["family"] * 5 + ["given-m"] * 2
