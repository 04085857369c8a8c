"""Token ids by word: the same ids as the tokenizer gives for the whole text, with words remembered.

The tokenizer's pre-tokeniser never joins what white space separates, so a text's ids are those of its parts between
spaces and line feeds, one after another. A part that is in composed form and whose lower-casing changes no length is cut on
into runs by the pre-tokeniser's own pattern; these runs repeat far more often than parts do.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

# Fixed value: the pre-tokeniser's pattern, which it applies to lower-cased text.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Characters of a part or run that is remembered, at most.
LONGEST = 64


def byte_characters() -> list[str]:
    """The character of each byte in byte-level BPE: printable ones stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


@lru_cache(maxsize=2)
def word_bpe(path: str, remembered: int) -> Callable[[str], bytes]:
    """Encoder from text to little-endian unsigned 32-bit ids; ``remembered`` bounds its memory of parts and of runs, each of
    LONGEST characters at most."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    with open(path) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    model, chars, find = full.model, byte_characters(), regex.compile(RUNS).findall
    parts: dict[str, bytes] = {"": b""}
    runs: dict[str, bytes] = {}
    pack = lambda ids: b"".join([i.to_bytes(4, "little") for i in ids])

    def run_ids(run: str) -> bytes:
        if (got := runs.get(run)) is None:
            got = pack([t.id for t in model.tokenize("".join([chars[b] for b in run.encode()]))])
            if len(run) <= LONGEST:
                if len(runs) >= remembered:
                    runs.clear()
                runs[run] = got
        return got

    def part_ids(part: str) -> bytes:
        low = part.lower()
        plain = part.isascii() or (
            len(low) == len(part) and "Σ" not in part and unicodedata.is_normalized("NFC", part)
        )
        if plain and not any(s in part for s in special):
            got = b"".join([run_ids(r) for r in find(low)])
        else:
            got = pack(full.encode(part, add_special_tokens=False).ids)
        if len(part) <= LONGEST:
            if len(parts) >= remembered:
                parts.clear()
                parts[""] = b""
            parts[part] = got
        return got

    def encode(text: str) -> bytes:
        get = parts.get
        return b"".join([got if (got := get(p)) is not None else part_ids(p) for p in text.replace("\n", " ").split(" ")])

    return encode
