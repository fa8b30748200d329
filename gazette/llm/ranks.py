"""Ids of whole texts by a byte-level BPE file of the tokenizers library, merged by rank.

In such a file a piece's id is its rank: of two neighbouring pieces those are merged first whose merged piece has the smallest
id. That is how tiktoken merges, several times as fast as the library itself on texts of many different words. A file whose
merges are not in the order of their ids is left to the library.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import tiktoken

from gazette.llm.bpe import WORD, byte_of_letter, tokenizer


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every id; special tokens are their own text."""
    letters, vocab = byte_of_letter(), tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, one in vocab.items():
        pieces[one] = bytes(map(letters.__getitem__, piece)) if all(c in letters for c in piece) else piece.encode()
    return pieces


def text_ids(path: str, plain_specials: bool = False, arrays: bool = False) -> Callable:
    """Function from a text to its ids, as the library's ``encode`` without special tokens at the ends gives them.

    Strings of special tokens in a text are those tokens, or plain text with ``plain_specials``. Ids are a list, with ``arrays`` an array
    where the merges are in order.
    """
    library = tokenizer(path)
    library.encode_special_tokens = plain_specials
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    vocab, merges = found["model"]["vocab"], found["model"]["merges"]
    special = {one["content"]: one["id"] for one in found["added_tokens"]}
    made = [vocab["".join(one.split(" ") if isinstance(one, str) else one)] for one in merges]
    if made != sorted(made) or any(one["lstrip"] or one["rstrip"] or one["single_word"] or one["normalized"] for one in found["added_tokens"]):
        return lambda text: library.encode(text, add_special_tokens=False).ids
    pieces = piece_bytes(path)
    ranks = {pieces[one]: one for piece, one in vocab.items() if piece not in special}
    encoding = tiktoken.Encoding("ranks", pat_str=WORD, mergeable_ranks=ranks, special_tokens=special)
    if arrays:
        allowed = set() if plain_specials else "all"
        return lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    if plain_specials or not special:
        return encoding.encode_ordinary
    return lambda text: encoding.encode(text, allowed_special="all") if any(one in text for one in special) else encoding.encode_ordinary(text)
