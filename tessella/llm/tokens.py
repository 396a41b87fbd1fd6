"""Token ids by public tokenizers, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

Both splits below cut only where the tokenizer itself always cuts, so the ids of a text are those of
its parts one after the other, and a part that was met before is looked up instead of encoded again.
A text that holds the string of a special token goes through the library as a whole, which then gives
that token's id; with ``special_is_text`` it is ordinary text.

A byte-level model whose merges stand in the order of their ids gives the same ids by merging the pair
with the lowest id first. Plain words and texts, of characters about which no two versions of Unicode differ,
take that way with the merging of ``tiktoken``, for models with word ends with a space, which no word has, as the
end of a word; all others go through the library in parts.

Defined results: an empty text has no ids; texts are independent, so ties, repeated texts and their order
need no rule; nulls are the caller's, who passes them as empty texts; no texts give no ids.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Sequence
from itertools import chain, filterfalse

import numpy as np

from tessella.llm.common import process_cache

ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ASCII_SPACES = re.compile("[ \t-\r]+")
SPACE_BESIDE_SPACE = re.compile(r"\s | \s|\A | \Z")
SPACES_BESIDE = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r", "\v ", " \v", "\f ", " \f")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
NOT_PLAIN = re.compile("[^\t\n\r -~À-ɏ‘’“”–—…«»€]")
# fixed value: how byte-level models of this kind cut a text before they merge
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD_END = b" "  # no word has a space
# models with word ends cut a text in lower case into these, runs of letters, single digits and runs of others
CONTRACTION = re.compile(r"'(?<![^\w\s]')(?<!_')([stmd]|re|ve|ll)")
APOSTROPHE = "\0"  # stands for that of a contraction, which is no mark of its own
KIND = np.array([0 if c.isspace() else 1 if c.isalpha() or c == APOSTROPHE else 2 if c.isdigit() else 3 for c in map(chr, range(0x2D00))], np.uint8)
WORD_CUT = "[^ ]+ "
DOTTED_I = "\u0130"  # becomes two characters in lower case, the second of which is no letter
MARKS = ",.!?;:"
JOINED = 500  # words encoded as one text
CACHE_BYTES = 110_000_000
ENTRY_BYTES = 120


def words_of(text: str) -> list[str]:
    """Parts of a text for a tokenizer that drops white space."""
    return ASCII_SPACES.split(text) if ODD_SPACE.search(text) else text.split()


def spaced_parts(text: str) -> list[str]:
    """Parts of a text for a tokenizer that keeps a single space with the word behind it; that space
    is left out of all parts but the first."""
    beside = text[:1] == " " or text[-1:] == " " or any(map(text.__contains__, SPACES_BESIDE)) or ODD_SPACE.search(text)
    return LONE_SPACE.split(text) if beside and SPACE_BESIDE_SPACE.search(text) else text.split(" ")


class PartEncoder:
    """Encodes texts part by part with a tokenizer of the ``tokenizers`` library.

    ``model`` is the JSON text of the tokenizer. Parts not met before are encoded many at a time: words of letters as one text, whose ids are dealt to the
    words where tokens begin with ``begins`` or end with ``ends``; other parts one by one. The parts
    remembered are bounded in bytes; beyond that the memory starts anew.
    """

    def __init__(self, name: str, model: str, split: Callable[[str], list[str]], lead: str, begins: str = "", ends: str = "",
                 special_is_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = process_cache(f"tokenizer {name}")
        if not kept:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model)
            tokenizer.encode_special_tokens = special_is_text
            special = [] if special_is_text else [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
            vocabulary = tokenizer.get_vocab()
            border = np.zeros(max(vocabulary.values()) + 1, bool)
            border[[i for token, i in vocabulary.items() if token.startswith(begins) and token.endswith(ends)]] = True
            merger = _merger(model, ends) if ends else None
            kept.update(tokenizer=tokenizer, border=border, special=special, merger=merger, first={}, later={}, size=0)
        self.kept, self.split, self.lead, self.at_end = kept, split, lead, bool(ends)

    def _one_by_one(self, parts: list[str], lead: str) -> dict[str, bytes]:
        done = self.kept["tokenizer"].encode_batch_fast([lead + p for p in parts], add_special_tokens=False)
        return {p: array("I", x.ids).tobytes() for p, x in zip(parts, done)}

    def _together(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of words of letters, by way of texts that hold many of them."""
        texts = [lead + " ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        done = self.kept["tokenizer"].encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in done]) if done else np.zeros(0, "<u4")
        borders = np.flatnonzero(self.kept["border"][ids])
        if len(borders) != len(words):  # a letter here that is none for the tokenizer
            return self._one_by_one(words, lead)
        stops = borders + 1 if self.at_end else np.append(borders[1:], len(ids))
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        raw = ids.tobytes()
        return dict(zip(words, map(raw.__getitem__, map(slice, (4 * starts).tolist(), (4 * stops).tolist()))))

    def _learn(self, new: set[str], known: dict[str, bytes], lead: str) -> None:
        # both tokenizers cut between letters and punctuation, so a mark at the end of a word stands alone
        marked = {p for p in new if p[-1:] in MARKS and p[:-1].isalpha()}
        bare = set(filterfalse(known.__contains__, chain(new - marked, [p[:-1] for p in marked])))
        # without a space before it, a word's first token does not tell where it begins
        words = list(filter(str.isalpha, bare)) if self.at_end or lead else []
        if self.kept["merger"]:
            piece = self.kept["merger"]._encode_single_piece
            plain = list(filter(PLAIN_WORD.fullmatch, words))
            known.update(zip(plain, [array("I", piece(w.lower().encode() + WORD_END)).tobytes() for w in plain]))
            rest = [w for w in words if w not in known]
        else:
            rest = words
        known.update(self._together(rest, lead))
        known.update(self._one_by_one(list(bare.difference(words)), lead))
        ends = self._one_by_one(list(MARKS), "") if marked else {}
        known.update({p: known[p[:-1]] + ends[p[-1]] for p in marked})
        self.kept["size"] += sum(map(len, new)) + ENTRY_BYTES * (len(new) + len(bare))

    def is_special(self, text: str) -> bool:
        """Whether a special token may stand in the text."""
        special = self.kept["special"]
        return bool(special) and any(map(text.lower().__contains__, special))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.kept["size"] > CACHE_BYTES:
            self.kept.update(first={}, later={}, size=0)
        whole = {k for k, t in enumerate(texts) if self.is_special(t)}
        parted = [[] if k in whole else self.split(t) for k, t in enumerate(texts)]
        heads = [b""] * len(texts)
        if self.lead:
            first = self.kept["first"]
            self._learn({p[0] for p in parted if p}.difference(first), first, "")
            heads, parted = [first[p[0]] if p else b"" for p in parted], [p[1:] for p in parted]
        # most parts are known: each is looked up once, and those that miss are learnt together
        known = self.kept["later"]
        found = [list(map(known.get, p)) for p in parted]
        missing = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        self._learn({p[i] for p, at in zip(parted, missing) for i in at}, known, self.lead)
        for p, f, at in zip(parted, found, missing):
            for i in at:
                f[i] = known[p[i]]
        out = [head + b"".join(f) for head, f in zip(heads, found)]
        for k in whole:
            out[k] = array("I", self.kept["tokenizer"].encode(texts[k], add_special_tokens=False).ids).tobytes()
        return out


class ByteEncoder:
    """Encodes texts with a byte-level model: plain ones by merging pairs of bytes, others in parts."""

    def __init__(self, name: str, model: str, special_is_text: bool = False):
        self.parts = PartEncoder(name, model, spaced_parts, " ", begins="Ġ", special_is_text=special_is_text)
        kept = process_cache(f"merger {name}")
        if not kept:
            kept["merger"] = _merger(model)
        self.merger = kept["merger"]

    def _plain(self, text: str) -> bytes | None:
        if self.merger is None or NOT_PLAIN.search(text) or self.parts.is_special(text):
            return None
        try:
            return np.array(self.merger.encode_ordinary(text), "<u4").tobytes()
        except ValueError:  # the cutting pattern gives up on endless white space
            return None

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = [self._plain(t) for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.parts.encode([texts[k] for k in rest])):
            out[k] = ids
        return out


def _words_apart(text: str) -> str:
    """A plain text in lower case with one space or more behind each of its words."""
    if "'" in text:
        text = CONTRACTION.sub(rf" {APOSTROPHE}\1 ", text)
    code, letter = ("ascii", np.uint8) if text.isascii() else ("utf-32-le", np.dtype("<u4"))
    raw = np.frombuffer(bytearray(text.encode(code)), letter)
    kind = KIND[raw]
    raw[kind == 0] = 32
    left, right = kind[:-1], kind[1:]
    cut = ((left != right) | (right == 2)) & (left > 0) & (right > 0)
    return np.insert(raw, np.flatnonzero(cut) + 1, 32).tobytes().decode(code).replace(APOSTROPHE, "'") + " "


class WordEncoder:
    """Encodes texts with a model that drops white space and marks word ends: plain ones word by word in one
    call each, others in parts."""

    def __init__(self, name: str, model: str, special_is_text: bool = False):
        self.parts = PartEncoder(name, model, words_of, "", ends="</w>", special_is_text=special_is_text)
        self.merger = self.parts.kept["merger"]

    def _plain(self, text: str) -> bytes | None:
        if self.merger is None or NOT_PLAIN.search(text) or DOTTED_I in text or self.parts.is_special(text):
            return None
        return array("I", self.merger.encode_ordinary(_words_apart(text.lower()))).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = [self._plain(t) for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.parts.encode([texts[k] for k in rest])):
            out[k] = ids
        return out


def _merger(model: str, ends: str = ""):
    """Merging by ids for a byte-level model, none if its merges have another order. ``ends`` marks the last
    letter of a word; a word is then given with ``WORD_END`` behind it."""
    import tiktoken

    said = json.loads(model)
    vocabulary, merges = said["model"]["vocab"], said["model"]["merges"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    # a byte that cannot be shown stands for the next letter from 256 on
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    base = set(letters) | {c + ends for c in letters}
    order = [vocabulary.get(a + b) for a, b in pairs]
    if not base <= set(vocabulary) or None in order or order != sorted(order) or max(vocabulary[c] for c in base) >= min(order, default=0):
        return None
    tokens = base.union(a + b for a, b in pairs)
    raw = lambda t: bytes(map(letters.__getitem__, t.removesuffix(ends))) + (WORD_END if ends and t.endswith(ends) else b"")
    ranks = {raw(t): vocabulary[t] for t in tokens}
    if len(ranks) < len(tokens):  # a token with a space in it looks like one at the end of a word
        return None
    return tiktoken.Encoding("by ids", pat_str=WORD_CUT if ends else CUT, mergeable_ranks=ranks, special_tokens={})


def word_encoder(name: str, model: str) -> WordEncoder:
    return WordEncoder(name, model)


def byte_encoder(name: str, model: str) -> ByteEncoder:
    return ByteEncoder(name, model)
