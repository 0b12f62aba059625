"""The public tokenizer libraries inside tasks: one instance per worker and file, texts in batches of about equal size.

A long text is encoded in pieces, cut at safe boundaries: at a blank that follows anything but white space, at a blank
just before anything but white space, or, where no blank comes, between a letter and a punctuation mark.  No pre-token
of the pattern crosses these places, and the added special token holds none of them, so the ids of a text are the ids of
its pieces in order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Characters encoded at a time; a longer text is cut at safe boundaries into pieces of about this size.
BATCH_CHARS = 1 << 18
PIECE_CHARS = 1 << 16

_BLANK = re.compile(r"(?<=\S)(?= )|(?<=\s)(?= \S)")
#: Letters and marks of punctuation that are such in every version of Unicode.
_STOP = re.compile("(?<=[A-Za-zぁ-ゖァ-ヺ一-龥가-힣ก-ฮ])(?=[.,;:!?。，！？、；：])")


@functools.cache
def tokenizer(path: str):
    """The tokenizers encoder for a .json file, one per worker; special strings are handled as its default."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    """The special strings that the encoder of a .json file knows inside texts."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@functools.cache
def rank_encoding(path: str):
    """The tiktoken encoding for a .tiktoken file, one per worker, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_size(texts: Iterable[str | None], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive groups of texts (null: empty) of at most ``limit`` characters, or of one longer text."""
    group, size = [], 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """A long text in pieces of about ``limit`` characters, cut at safe boundaries; whole where it has none."""
    at = 0
    while len(text) - at > limit:
        cut = _BLANK.search(text, at + limit, at + 2 * limit) or _STOP.search(text, at + limit) or _BLANK.search(text, at + 2 * limit - 2)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def count(texts: list[str], json_path: str) -> list[int]:
    """Numbers of ids by the tokenizers library."""
    return [len(e) for e in tokenizer(json_path).encode_batch_fast(texts, add_special_tokens=False)]


def ids(text: str | None, json_path: str, rank_path: str) -> np.ndarray:
    """The tokenizers library's ids of a text (null: empty) as uint32.

    tiktoken's ranks of the same vocabulary give the same ids several times faster; a text with a special string, which
    they do not know, goes to the tokenizers library.
    """
    text = text or ""
    if any(s in text for s in special_strings(json_path)):
        return np.array(tokenizer(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    encode = rank_encoding(rank_path).encode_to_numpy
    found = [np.asarray(encode(p, disallowed_special=()), dtype="<u4") for p in pieces(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def width(json_path: str, *others: int) -> int:
    """Bytes an id needs, 2 or 4: the largest two-byte number is left free."""
    return 2 if max(tokenizer(json_path).get_vocab_size(with_added_tokens=True) - 1, *others) < 65_535 else 4
