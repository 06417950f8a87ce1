"""Whole texts to token ids by a public byte-level tokenizer file, and a bounded memo of pre-tokens."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
from array import array
from functools import cache
from itertools import islice

#: Entries of the memo's younger half; at that size the older half is dropped.
MEMO_LIMIT = 250_000


class WordMemo:
    """Maps pre-tokens to values: recent ones from two generations of bounded dictionaries, new ones by `solve`, a list at a time."""

    def __init__(self, solve, limit: int = MEMO_LIMIT):
        self.solve, self.limit = solve, limit
        self.young: dict = {}
        self.old: dict = {}

    def ready(self, pieces: set) -> dict:
        """A dictionary that holds at least these pieces."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        new = pieces.difference(self.young)
        for piece in new.intersection(self.old):
            self.young[piece] = self.old[piece]
        new = [x for x in new if x not in self.young]
        if new:
            self.young.update(zip(new, self.solve(new), strict=True))
        return self.young


class Encoder:
    """Ids of the tokenizers library's encode(text, add_special_tokens=False) for a byte-level BPE file; an added token's string in a text is that token.

    The library itself encodes about 2.5 MB a second on one core. tiktoken, given the same file's
    vocabulary as ranks (a token's id is its rank), does so at four times that speed; it does the work where
    `same` says that it gives the same ids (see same_ids), but for texts with the string of an added token, which
    always go to the library.
    """

    def __init__(self, path: str, pattern: str, same: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.same = Tokenizer.from_file(path), same
        added = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = _tiktoken(path, pattern, set(added)) if same else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.same:
            return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [array("I", self._ids(text)).tobytes() for text in texts]

    def _ids(self, text: str) -> list[int]:
        if self.added and self.added.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _tiktoken(path: str, pattern: str, added: set[str]):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    as_byte = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(as_byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def same_ids(path: str, pattern: str) -> bool:
    """Whether tiktoken gives the library's ids for every text without an added token; asked once, on the driver, by a process of its own, whose memory ends with it."""
    ask = f"import sys; from {__name__} import _same_ids; print(_same_ids(*sys.argv[1:]))"
    done = subprocess.run([sys.executable, "-c", ask, path, pattern], env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, stdout=subprocess.PIPE, text=True, check=True)
    return done.stdout.split()[-1:] == ["True"]


def _same_ids(path: str, pattern: str) -> bool:
    """See same_ids.

    Pre-tokens. The file's only pre-tokenizer is the byte-level one with its own expression, and no normalizer or
    post-processor changes a text. That expression tells characters apart by class and ASCII letters alone, so it is
    compared on every code point behind a letter, a digit and a space. Merges. Both libraries
    merge the adjacent pair of least rank, the leftmost first, but one knows listed pairs and the other all
    pairs that spell a token. They agree if each longer token has one listed pair, ids ascend with the
    list, and the library merges each token's own bytes to that token: for then, were two neighbours
    x, y that spell a token t not its listed pair, the merges so far inside of them would be the start of those of t alone,
    which end in the listed pair and so never pass by x, y.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = (model.get("type") or "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not file["normalizer"] and not file["post_processor"]
    if not plain or not whole:
        return False
    library = Tokenizer.from_file(path)
    added = {t.content for t in library.get_added_tokens_decoder().values()}
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"].get(t, -1) for t in made]
    longer = {t for t in model["vocab"] if len(t) > 1 and t not in added}
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or set(made) != longer or set(_byte_letters().values()) - set(model["vocab"]):
        return False
    if any([x.id for x in library.model.tokenize(t)] != [model["vocab"][t]] for t in longer):
        return False
    fast = _tiktoken(path, pattern, added)
    # Some thousand code points at a time: the library's results take a hundred times their text.
    texts = ("".join(f"a{c}1 {c}" for c in map(chr, range(i, i + 2048)) if not 0xD800 <= ord(c) < 0xE000) for i in range(0, 0x110000, 2048))
    while some := list(islice(texts, 8)):
        if any(x.ids != fast.encode_ordinary(t) for x, t in zip(library.encode_batch_fast(some, add_special_tokens=False), some, strict=True)):
            return False
    return True


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE files write for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_encoders: dict[tuple[str, str, bool], Encoder] = {}


def encode_all(texts: list[str], path: str, pattern: str, same: bool) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, by this worker's encoder for the file; same is what same_ids says."""
    if (path, pattern, same) not in _encoders:
        _encoders[path, pattern, same] = Encoder(path, pattern, same)
    return _encoders[path, pattern, same].encode(texts)


def id_width(path: str) -> int:
    """Bytes that every id of a tokenizer file fits in: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
