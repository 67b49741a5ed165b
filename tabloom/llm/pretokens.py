"""Splitting texts into pre-tokens exactly as the public tokenizer libraries do."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex

# Code points that the installed regex module calls letters or
# numbers and that the tokenizer libraries (Unicode 16) do not know yet.
UNKNOWN = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    r"\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f")


def _latin(pattern: str) -> re.Pattern:
    """``pattern`` with its Unicode classes spelled out for U+0000 to U+00FF."""
    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c)))
    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    for name, text in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"), (r"\S", f"[^{space}]"),
                       (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(name, text)
    return re.compile(pattern)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Function from a text to all matches of ``pattern``.  Latin-1 texts take the
    pattern with explicit classes (faster), texts with ``UNKNOWN`` the one that excludes those."""
    latin, plain = _latin(pattern).findall, regex.compile(pattern).findall
    exact = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", "@OTHER@")
                          .replace(r"\p{L}", rf"[\p{{L}}--[{UNKNOWN}]]").replace(r"\p{N}", rf"[\p{{N}}--[{UNKNOWN}]]")
                          .replace("@OTHER@", rf"[[^\s\p{{L}}\p{{N}}]||[{UNKNOWN}]]")).findall
    odd = regex.compile(f"[{UNKNOWN}]").search

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return exact(text) if odd(text) else plain(text)
        return latin(text)
    return split


def portions(batches, chars: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of Arrow batches (id, text), cut so that a portion ends with the
    document that reaches ``chars``; a null text is empty."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = text.as_py() or ""
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts
