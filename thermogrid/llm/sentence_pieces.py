"""SentencePiece ids of whole texts through a table of distinct chunks, and the texts back from the ids."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermogrid.llm.textarrays import give_back

MARK = "▁"
#: Bounds of one task's memory, none of which changes a result: characters of text encoded at once, characters of a chunk
#: beyond which it is cut further, chunks and characters that a table keeps before it starts afresh.
SLICE, LONG, KEPT, KEPT_CHARS = 1 << 20, 1 << 12, 1 << 19, 1 << 24
_MARKED = re.compile(" +[^ ]*")


class Chunker:
    """A model, and where its texts fall apart into chunks that it segments one without the other.

    A chunk is a run of whitespace markers and what follows up to the next run. Where no piece has a marker after another
    character, no merge crosses from one chunk into the next. By the same reasoning two neighbouring characters that stand
    side by side in no piece part a long chunk. A model of another kind (not BPE, normalising, without the marker in
    front) gets whole texts.
    """

    def __init__(self, file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        rules = spec.normalizer_spec
        pieces = [p.piece for p in spec.pieces]
        self.marked = (
            spec.trainer_spec.model_type == spec.trainer_spec.BPE
            and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not rules.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        )
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # A character that no piece holds stays apart from what follows; a text after it is not given the marker in front.
        self.guard = "\n"
        self.bare = self.marked and not any(self.guard in p for p in pieces)
        self.lead = len(self.model.encode(self.guard)) if self.bare else 0

    def slices(self, text: str, limit: int) -> Iterator[list[str]]:
        """Chunks of a text, each without its first marker, in lists of about `limit` characters."""
        if not text:
            return
        if not self.marked:
            yield [text]
            return
        text = text.replace(MARK, " ")
        at = 0
        while at < len(text):
            to = len(text)
            if to - at > limit:
                to = text.find(" ", at + limit)
                while 0 < to < len(text) and text[to - 1] == " ":  # within a run of markers: go to its start
                    to -= 1
                if to <= at:
                    to = len(text)
            part = text[at:to]
            # The first chunk of a text has a marker put in front, any other begins with one of its own.
            if at == 0 and not part.startswith(" ") and "  " not in part and not part.endswith(" "):
                yield part.split(" ")
            elif at and not part.startswith("  ") and "  " not in part and not part.endswith(" "):
                yield part[1:].split(" ")
            else:
                yield [c[1:] for c in _MARKED.findall(part if at else " " + part)]
            at = to

    def _bare(self, texts: list[str]) -> list[list[int]]:
        return [ids[self.lead :] for ids in self.model.encode([self.guard + t for t in texts], num_threads=1)]

    def _long(self, chunk: str) -> list[int]:
        chunk = MARK + chunk.replace(" ", MARK)
        parts, at = [], 0
        for i in range(1, len(chunk)):
            if i - at >= 64 and chunk[i - 1 : i + 1] not in self.pairs:
                parts.append(chunk[at:i])
                at = i
        return [i for ids in self._bare([*parts, chunk[at:]]) for i in ids]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk, given without its first marker, which the library puts in front of a text."""
        if not self.marked:
            return self.model.encode(chunks, num_threads=1)
        found = self.model.encode(chunks, num_threads=1)
        return [ids or self._bare([MARK])[0] for ids in found]  # the library gives an empty text no marker

    def segment(self, chunks: list[str]) -> list[list[int]]:
        if not self.bare or max(map(len, chunks), default=0) <= LONG:
            return self.encode(chunks)
        short = iter(self.encode([c for c in chunks if len(c) <= LONG]))
        return [next(short) if len(c) <= LONG else self._long(c) for c in chunks]


class ChunkTable:
    """Distinct chunks with their ids, each segmented when it is first met."""

    def __init__(self, chunker: Chunker):
        self.chunker, self.segmented = chunker, 0
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.pool, self.used, self.chars = np.zeros(1 << 12, np.int32), 0, 0

    @staticmethod
    def _grown(values: np.ndarray, need: int) -> np.ndarray:
        return values if need <= len(values) else np.concatenate([values, np.zeros(max(need - len(values), len(values)), values.dtype)])

    def _add(self, chunks: list[str]) -> None:
        ids = self.chunker.segment(chunks)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.slot), int(sizes.sum())
        self.start, self.size = self._grown(self.start, first + len(ids)), self._grown(self.size, first + len(ids))
        self.pool = self._grown(self.pool, self.used + total)
        self.start[first : first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(ids)] = sizes
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        self.used += total
        self.chars += sum(map(len, chunks))
        self.slot.update(zip(chunks, range(first, first + len(chunks))))
        self.segmented += len(chunks)

    def join(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks by position, and how many each chunk has."""
        distinct = set(chunks)
        if len(self.slot) + len(distinct) > KEPT or self.chars > KEPT_CHARS:
            self._clear()
        lacking = list(distinct.difference(self.slot))
        if lacking:
            self._add(lacking)
        slots = np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))
        size = self.size[slots]
        shift = np.repeat(self.start[slots] - (np.cumsum(size) - size), size)
        return self.pool[np.arange(len(shift)) + shift], size


@functools.lru_cache(maxsize=1)
def chunker(file: str) -> Chunker:
    return Chunker(file)


def _blocks(table: ChunkTable, texts: list[str | None], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, ids, offsets) of runs of texts of about `limit` characters; one long text is a run, encoded slice by slice."""
    row = 0
    while row < len(texts):
        first, chunks, counts, chars, done = row, [], [], 0, []
        while row < len(texts) and chars < limit:
            text, n = texts[row] or "", 0
            if chars and chars + len(text) > limit:
                break
            for part in table.chunker.slices(text, limit):
                if len(text) > limit:  # such a text is alone in its run
                    done.append(table.join(part)[0])
                else:
                    chunks += part
                    n += len(part)
            counts.append(n)
            chars += len(text)
            row += 1
        if done:
            ids = np.concatenate(done)
            yield first, ids, np.array([*[0] * (row - first), len(ids)], np.int64)
            continue
        ids, size = table.join(chunks)
        ends = np.concatenate([[0], np.cumsum(size)])
        yield first, ids, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


def _encoder(file: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(chunker(file))
        for b in batches:
            for first, ids, offsets in _blocks(table, b.column(1).to_pylist(), limit):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(lists)), lists], ["doc_id", "ids"])
            give_back()

    return run


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE) -> DataFrame:
    """One row per document: doc_id and `ids`, what the library's encode gives for the whole text without begin or end ids.

    Each task cuts texts into chunks at whitespace markers, keeps a table of the distinct chunks it has met, segments each of
    them once and joins the ids back by position. Nothing is shuffled: a table shared by all tasks would send every block's
    distinct chunks and the whole texts through the cluster to spare about a microsecond a chunk. The table starts afresh
    past a fixed number of chunks or characters, so a task's memory does not grow with the input.

    A null text counts as empty and has no ids; repeated rows are rows of their own; other columns, whatever their names, are left
    out; an empty table gives no rows. A very long text is encoded slice by slice, but its ids make one row: four bytes an id
    must fit a worker. A long chunk without white space is cut where no piece has the two characters side by side.
    """
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return light.mapInArrow(_encoder(model_file, slice_chars), "doc_id long, ids array<int>")


def _decoder(file: str, limit: int):
    def parts(ids: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Slices of about `limit` ids that begin with a whitespace marker."""
        at = 0
        while at < len(ids):
            to = len(ids)
            if to - at > limit:
                open_ = np.flatnonzero(starts[ids[at + limit :]])
                to = at + limit + int(open_[0]) if len(open_) else to
            yield ids[at:to]
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chunker(file).model
        starts = np.array([model.id_to_piece(i).startswith(MARK) for i in range(model.get_piece_size())])
        guard = model.encode("a")
        lead = len(model.decode(guard))

        def text(ids: np.ndarray) -> str:
            if len(ids) <= limit:
                return model.decode(ids.tolist())
            # Only the first piece of a text loses its marker: later slices go behind a letter, which is taken off again.
            return "".join(model.decode(x.tolist()) if not k else model.decode([*guard, *x.tolist()])[lead:] for k, x in enumerate(parts(ids, starts)))

        for b in batches:
            at = b.schema.get_field_index("ids")
            lists = b.column(at)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out = [text(values[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return run


def decode(tokens: DataFrame, model_file: str, slice_ids: int = SLICE) -> DataFrame:
    """Rows of encode() with `decoded`, what the library's decode makes of the ids; no ids give an empty text.

    Many ids are decoded slice by slice, each from a piece with a whitespace marker, so bytes of one character stay together.
    """
    schema = "doc_id long, ids array<int>, decoded string"
    return tokens.select("doc_id", "ids").mapInArrow(_decoder(model_file, slice_ids), schema)
