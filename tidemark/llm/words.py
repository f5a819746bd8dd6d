"""Splitting texts into the words that tokenizers merge within."""

from __future__ import annotations

import functools
import re
import unicodedata

import regex

#: Letters, numbers and white space below U+0100, as Unicode has them.
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\\t-\\r \x85\xa0"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Below U+0100 these give the matches of the general patterns at several times their speed.
_BYTE_LATIN = re.compile(
    f" ?[{_LETTERS}]+|{_CONTRACTIONS}| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_LOWER_LATIN = re.compile(f"[{_LETTERS}]+|{_CONTRACTIONS}|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_LOWER = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+")
#: Scripts whose characters have had their classes through all Unicode versions that the libraries may have.
_SETTLED = re.compile("[\0-՗֐-ۿ -⁣₠-₿←-⇿ぁ-ゖ゠-ヿ　-〃〈-】一-龥가-힣！-～]*")
_LATIN = re.compile("[\0-\xff]*")


def settled(text: str) -> bool:
    """If all characters are of scripts in which the libraries can't differ."""
    return _SETTLED.fullmatch(text) is not None


def latin(text: str) -> bool:
    return text.isascii() or _LATIN.fullmatch(text) is not None


@functools.lru_cache(4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def byte_words(text: str, pattern: str) -> list[str]:
    """The matches of the pattern of byte-level vocabularies in a text."""
    return _BYTE_LATIN.findall(text) if latin(text) else _compiled(pattern).findall(text)


@functools.lru_cache(4)
def _library(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lower_words(text: str, path: str) -> list[str]:
    """The words that the lower-casing vocabulary of path merges within; special tokens are not looked for."""
    if latin(text):
        return _LOWER_LATIN.findall(text.lower())
    if settled(text):
        return _LOWER.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
    library = _library(path)
    text = library.normalizer.normalize_str(text)
    return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
