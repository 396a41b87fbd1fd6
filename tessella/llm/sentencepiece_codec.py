"""SentencePiece encoding and decoding for merge-type (BPE) models with byte fallback.

A tokenization is the one that merging gives exactly if every two neighbours in it stay as they are
when their joined text is merged again: priorities are compared across the whole text, so the first
merge that crosses a border would already be seen in the pair. The encoder therefore walks the text
with the longest piece at each place, keeps a piece only if it stays beside the one before, tries
shorter ones otherwise, and goes back where none fits; ends known to fail are bits of a bitfield.
As only one tokenization of each prefix is the right one, a place fails or not whatever came before.

Defined results: a null text is an empty text; an empty text has the begin and end ids only (if asked
for); characters that no piece has become byte pieces; rows are independent, so ties and repeated
rows need no rule, and an empty table gives an empty table. Other columns stay; a column that has the
name of a new one is replaced by it.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import process_cache

SPACE = "▁"
MEMORY_BYTES, PAIR_LIMIT, ENTRY_BYTES, ROWS = 90_000_000, 300_000, 260, 256
SPACES_TOGETHER = re.compile(f"{SPACE}{SPACE}|{SPACE}\\Z")


class Memory(dict):
    """What ``make`` gives for a key, remembered within a bound of bytes."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.bytes = make, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        self.bytes += 2 * len(key) + len(value) + ENTRY_BYTES
        if self.bytes > MEMORY_BYTES:
            self.clear()
            self.bytes = 0
        self[key] = value
        return value


class PieceTable:
    """A model file's pieces, as far as decoding needs them."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        odd = [i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in odd if sp.is_byte(i)}
        if len(self.byte_ids) != 256 or any(sp.is_unused(i) for i in range(size)):
            raise ValueError("a merge-type model with byte pieces and without unused pieces is needed")
        hidden = set(odd)
        self.library = sp
        self.ids = {sp.id_to_piece(i): i for i in range(size) if i not in hidden}
        self.raw = [b""] * size
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.raw[i] = bytes([byte])
        self.byte_set = set(self.byte_ids.values())
        self.leading = {i for piece, i in self.ids.items() if piece.startswith(SPACE)}
        unknown = sp.unk_id()
        self.raw[unknown] = sp.decode([unknown]).encode()

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, the space put before a text
        taken off again. A byte that is not UTF-8 becomes U+FFFD, ids without a text nothing."""
        numbers = array("I", ids)
        raw = self.raw
        joined = b"".join(map(raw.__getitem__, numbers))
        first = next((i for i in numbers if raw[i]), None)
        lead = first in self.leading
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(numbers)
        return text[1:] if lead else text

    def _decode_runs(self, numbers: array) -> str:
        out, run = [], b""
        for i in [*numbers, None]:
            if i in self.byte_set:
                run += self.raw[i]
                continue
            while run:
                try:
                    out.append(run.decode())
                    run = b""
                except UnicodeDecodeError as e:
                    out.append(run[:e.start].decode() + "�")
                    run = run[e.start + 1:]
            if i is not None:
                out.append(self.raw[i].decode())
        return "".join(out)


class PieceModel(PieceTable):
    """The tables that encoding needs besides."""

    def __init__(self, model: bytes):
        super().__init__(model)
        sp = self.library
        self.normalize = sp.normalize
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.traces: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.choices: dict[str, dict[str | None, str]] = {}
        self.choice_count = 0
        self.chunks = Memory(self._chunk)
        self.words = Memory(lambda word: self._parts(SPACE + word))
        self.one_kind = self._cut_pattern()
        self.at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # pieces that merging their own text gives; the others never come out
        whole = [p for p in self.ids if len(p) == 1 or self.merge(p) == [p]]
        names = set(whole)
        # next shorter piece that a piece begins with
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in names), None) for p in whole}
        # longest piece at a place = first match that ends there in the reversed text
        self.matches = ahocorasick.Automaton()
        for piece in whole:
            self.matches.add_word(piece[::-1], piece)
        self.matches.make_automaton()

    def _cut_pattern(self) -> re.Pattern:
        """Parts that no piece crosses. Characters side by side in some piece are of one kind, and so
        are those linked by further such neighbours; a part is a run of one kind with the spaces
        before it, or a character that stands in no longer piece."""
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return re.compile(r"(?s).+")
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while kind.setdefault(c, c) != c:
                c = kind[c]
            return c

        for piece in longer:
            letters = piece.lstrip(SPACE)
            for a, b in zip(letters, letters[1:]):
                kind[root(a)] = root(b)
            if letters:
                root(letters[0])
        runs: dict[str, list[str]] = {}
        for c in kind:
            runs.setdefault(root(c), []).append(c)
        sets = "|".join("[" + "".join(map(re.escape, sorted(cs))) + "]+" for cs in sorted(runs.values(), key=len, reverse=True))
        return re.compile(f"(?s){SPACE}*(?:{sets})|{SPACE}+|." if sets else f"(?s){SPACE}+|.")

    def merge(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """Merging itself: the best-scored neighbours first, the leftmost of equals. ``steps`` gets the
        cost of every merge and the first and last part after it."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        last = len(parts) - 1
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            cost, i, left, right = heapq.heappop(heap)
            if parts[i] != left or (j := after[i]) >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            else:
                last = i
            if steps is not None:
                steps.append((cost, parts[0], parts[last]))
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _trace(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How a piece comes about: the costs of its merges, and its first and last part before and after each."""
        known = self.traces.get(piece)
        if known is None:
            steps: list[tuple[float, str, str]] = []
            self.merge(piece, steps)
            costs, firsts, lasts = zip(*steps) if steps else ((), (), ())
            known = self.traces[piece] = [*costs, math.inf], [piece[:1], *firsts], [piece[-1:], *lasts]
        return known

    def stays(self, left: str, right: str) -> bool:
        """Whether two pieces side by side are what merging makes of their text.

        Both merge as they do alone, the cheaper step first and the left one of equals, until a step
        across the border is the next.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        (left_costs, _, lasts), (right_costs, firsts, _) = self._trace(left), self._trace(right)
        i = j = 0
        while True:
            across = -self.scores.get(lasts[i] + firsts[j], -math.inf)
            if left_costs[i] <= across and left_costs[i] <= right_costs[j]:
                if left_costs[i] == math.inf:
                    known = True
                    break
                i += 1
            elif across <= right_costs[j]:
                known = False
                break
            else:
                j += 1
        if len(self.pairs) > PAIR_LIMIT:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def _fitting(self, last: str, piece: str | None) -> str:
        """The longest of a piece and the pieces it begins with that stays behind ``last``; none: empty."""
        first = piece
        while piece and last and not self.stays(last, piece):
            piece = self.shorter.get(piece)
        self.choice_count += 1
        if self.choice_count > PAIR_LIMIT:
            self.choices.clear()
            self.choice_count = 0
        self.choices.setdefault(last, {})[first] = piece = piece or ""
        return piece

    def split(self, text: str) -> list[str]:
        """The pieces of a normalized text, by backtracking."""
        n = len(text)
        # of the matches that end at one place the longest comes first, so it is set last here
        longest = dict([*self.matches.iter(text[::-1])][::-1])
        found: list[str] = []
        failed, pos, last = 0, 0, ""
        wanted = longest.get(n - 1, text[:1])
        while pos < n:
            after = self.choices.get(last) or {}
            while True:
                piece = after.get(wanted)
                if piece is None:
                    piece = self._fitting(last, wanted)
                if not (piece and failed and failed >> pos + len(piece) & 1):
                    break
                wanted = self.shorter.get(piece)
            if piece:
                found.append(piece)
                pos, last = pos + len(piece), piece
                wanted = longest.get(n - 1 - pos, text[pos:pos + 1])
            else:
                failed |= 1 << pos
                piece = found.pop()
                pos, last, wanted = pos - len(piece), found[-1] if found else "", self.shorter.get(piece)
        return found

    def _chunk(self, chunk: str) -> bytes:
        out = array("I")
        for piece in self.split(chunk):
            i = self.ids.get(piece)
            if i is None:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(i)
        return out.tobytes()

    def _parts(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.one_kind.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text, without begin and end, as little-endian unsigned 32-bit integers.

        No piece goes on behind a space within it, so a text is cut at single spaces first and
        between kinds of characters then.
        """
        text = self.normalize(text)
        if not self.at_spaces or SPACES_TOGETHER.search(text):
            return self._parts(text)
        first, *words = text.split(SPACE)
        return self._parts(first) + b"".join(map(self.words.__getitem__, words))


def load(model: bytes, kind: type[PieceTable]) -> PieceTable:
    kept = process_cache(kind.__name__)
    key = hash(model)
    if key not in kept:
        kept.clear()
        kept[key] = kind(model)
    return kept[key]


def _with_column(df: DataFrame, source: str, to: str, field: pa.DataType, kind: T.DataType, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``df`` with column ``to`` made from ``source``, few rows at a time: ids take more room than texts."""
    keep = [c for c in df.columns if c.lower() != to.lower()]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("_source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                few = batch.slice(i, ROWS)
                made = pa.array(convert(few.column(len(keep)).to_pylist()), field)
                yield pa.record_batch([*few.columns[:-1], made], [*few.schema.names[:-1], to])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(to, kind)]))


def _shared(df: DataFrame, path: str):
    """The model file's content, sent once to each executor."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids", ends: bool = True) -> DataFrame:
    """Add ``to``: the ids of column ``text`` as little-endian unsigned 32-bit integers in one binary.

    ``path`` is the model file; ``ends`` puts the model's begin and end ids around each text.
    """
    model = _shared(df, path)

    def make() -> Callable[[list], list]:
        pieces = load(model.value, PieceModel)
        begin, end = (array("I", [i]).tobytes() if ends else b"" for i in (pieces.begin, pieces.end))
        return lambda texts: [begin + pieces.encode(t or "") + end for t in texts]

    return _with_column(df, text, to, pa.binary(), T.BinaryType(), make)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add ``to``: the text of the ids in binary column ``ids`` (null: empty)."""
    model = _shared(df, path)

    def make() -> Callable[[list], list]:
        pieces = load(model.value, PieceTable)
        return lambda rows: [pieces.decode(x or b"") for x in rows]

    return _with_column(df, ids, to, pa.string(), T.StringType(), make)
