"""Best-fit packing of tokenised documents into sequences by a local search over swaps.

Tasks tokenise documents and cut only those longer than a sequence. Pieces as long as a sequence are done; the others go,
by the hash of their number, to shards of about SHARD pieces, each packed in one task. A shard's pieces are put into bins as
they come, each into the fullest bin that has room. The search does the rest: the emptiest bin gives a document away, one for
a smaller one, or two for one that is smaller than both together, to the underfull bin that is then filled best. Every step
raises the sum of squared fills. It goes on, bin by bin, until no underfull bin has a step left; bins that were emptied go.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from flowgauge.llm import support

CAPACITY = 2048
SHARD = 1 << 14
#: Words whose ids a worker keeps, some 200 bytes each; the ones not met for longest go. It bounds memory and changes no result.
CACHE = 200_000
#: Bytes of text that are tokenised together.
PART = 4 << 20


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level tokenizers write bytes as: printable ones for themselves, others from 256 on in turn."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + n for n, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Token ids of texts by a tokenizer file, with the ids of words it has met.

    The tokenizer lower-cases, never joins characters across white space and cuts between a letter and punctuation, so a
    text's ids are those of its words in order, and a word's those of its letters and of the marks behind them. Texts that
    may hold one of the tokenizer's special strings are passed to it whole.
    """

    #: A word of Latin letters, and marks behind it. Other words are passed on as they are.
    _SIMPLE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,!|;:?$%&*]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._mark_id = min(self._tokenizer.get_added_tokens_decoder())
        self._mark = self._tokenizer.id_to_token(self._mark_id)
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _unknown(self, words: set[bytes]) -> set[bytes]:
        """Those of ``words`` that must be tokenised; known ones are kept for longer."""
        missing = words - self._known.keys()
        met = missing & self._older.keys()
        self._known.update((w, self._older[w]) for w in met)
        return missing - met

    @staticmethod
    @cache
    def _pack(count: int):
        return struct.Struct(f"<{count}I").pack

    def _learn_letters(self, words: set[bytes]) -> None:
        """The ids of words of letters alone: each is one run for the tokenizer's model, whose letters are bytes."""
        tokenize = self._tokenizer.model.tokenize
        for word in self._unknown(words):
            run = word.decode() if word.isascii() else word.decode("latin-1").translate(_BYTE_LETTERS)
            self._known[word] = self._pack(len(ids := [t.id for t in tokenize(run)]))(*ids)

    def _learn(self, words: set[bytes]) -> None:
        """The ids of any words, tokenised together: a special string between them tells their ids apart."""
        missing = list(self._unknown(words))
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            ids = self._ids(self._mark.join([w.decode() for w in part]))
            cuts = np.flatnonzero(ids == self._mark_id)
            for word, start, end in zip(part, [0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
                self._known[word] = ids[start:end].tobytes()

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        if len(self._known) > CACHE // 2:
            self._known, self._older = {}, self._known
        known = self._known
        if missing := self._unknown(set(words)):
            letters = {w for w in missing if w.isalpha()}
            split = {w: m.groups() for w in missing - letters if (m := self._SIMPLE.fullmatch(w))}
            self._learn_letters(letters.union(run for run, _ in split.values()))
            self._learn((missing - letters - split.keys()).union(marks for _, marks in split.values() if marks))
            for word, (run, marks) in split.items():
                if marks:
                    known[word] = known[run] + known[marks]
        return [known[w] for w in words]

    def encode(self, texts) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow array of strings, as little-endian unsigned 32-bit numbers."""
        import pyarrow.compute as pc

        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):  # parts of about PART bytes, or one longer text
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + PART, side="right")))
            yield from self._part(pc.fill_null(texts.slice(start, end - start), ""))
            start = end

    def _part(self, texts) -> Iterator[np.ndarray]:
        import pyarrow.compute as pc

        apart = pc.match_substring(texts, "<|")
        special = {i: self._ids(texts[i].as_py()) for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist()}
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(apart, "", texts)))
        coded = words.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        found = self._of_words(coded.dictionary.cast("binary").to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(lengths) - lengths
        count = lengths[which]
        ends = np.cumsum(count)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - (ends - count), count)
        ids = table[take] if len(take) else np.zeros(0, "<u4")
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        for i in range(len(texts)):
            yield special[i] if i in special else ids[bounds[i] : bounds[i + 1]]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, so that its words outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id",
           with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and the ids where ``with_ids``."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(tokenizer)
        end = bytes(4)
        width = 4 * capacity
        for batch in batches:
            ids, owner, piece, start, length, crc, kept = batch.column(0), [], [], [], [], [], []
            for row, data in enumerate(encoder.encode(batch.column(1))):
                data = data.tobytes() + end
                for number, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    owner.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(kept, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return support.by_batch(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), run, schema)


def fill_bins(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` (each at most ``capacity``) by bin."""
    search = SwapSearch(lengths.tolist(), capacity)
    for i in range(len(lengths)):
        search.place(i)
    return search.run()


class SwapSearch:
    """Bins of documents, and steps between underfull ones.

    Underfull bins are known by what they have free, and each of their documents by its own size and that together: a document,
    or two, of that size can take its place and fill the bin. So a step is found without a look at all bins. The sizes at hand
    are bits of a number, whose lowest one from the wanted size on leaves the least free.
    """

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity = size, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self._rooms: dict[int, dict[int, None]] = {}
        self._places: dict[int, dict[int, int]] = {}
        self._room_sizes = self._place_sizes = 0
        #: How often a step was a move, an exchange of one for one, or of two for one, and how many bins were emptied.
        self.steps = {"move": 0, "one": 0, "two": 0, "emptied": 0}

    def place(self, i: int) -> None:
        """Put a document into the fullest bin that has room, or a new one."""
        room = self._least(self._room_sizes, self.size[i])
        if room is None:
            self.add([i])
        else:
            at = next(iter(self._rooms[room]))
            self._hide(at)
            self.bins[at].append(i)
            self.free[at] -= self.size[i]
            self._show(at)

    def add(self, held: list[int]) -> None:
        """A new bin of these documents."""
        self.bins.append(list(held))
        self.free.append(self.capacity - sum(self.size[i] for i in held))
        self._show(len(self.bins) - 1)

    @staticmethod
    def _least(sizes: int, wanted: int) -> int | None:
        fitting = sizes >> wanted
        return wanted + (fitting & -fitting).bit_length() - 1 if fitting else None

    def _show(self, at: int) -> None:
        free = self.free[at]
        if free and self.bins[at]:
            self._rooms.setdefault(free, {})[at] = None
            self._room_sizes |= 1 << free
            for i in self.bins[at]:
                self._places.setdefault(free + self.size[i], {})[i] = at
                self._place_sizes |= 1 << free + self.size[i]

    def _hide(self, at: int) -> None:
        free = self.free[at]
        if free and self.bins[at]:
            del self._rooms[free][at]
            if not self._rooms[free]:
                self._room_sizes &= ~(1 << free)
            for i in self.bins[at]:
                held = free + self.size[i]
                del self._places[held][i]
                if not self._places[held]:
                    self._place_sizes &= ~(1 << held)

    def _offers(self, giver: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        own = self.bins[giver]
        for i in own:
            yield self.size[i], (i,)
        for n, i in enumerate(own):
            for j in own[:n]:
                if self.size[i] + self.size[j] <= self.capacity:
                    yield self.size[i] + self.size[j], (i, j)

    def best_step(self, giver: int) -> tuple[int, tuple[int, ...], int | None] | None:
        """(taker, what it gets, what it gives back) of the step that leaves the taker the least room, and moves most at that.

        The taker is at least as full as the giver, so the sum of squares rises.
        """
        best, found = None, None
        for total, out in self._offers(giver):
            room = self._least(self._room_sizes, total) if len(out) == 1 else None
            if room is not None and room <= self.free[giver] and (best is None or (room - total, -total) < best):
                taker = next((t for t in self._rooms[room] if t != giver), None)
                if taker is not None:
                    best, found = (room - total, -total), (taker, out, None)
            held = self._least(self._place_sizes, total)
            while held is not None and (best is None or held - total <= best[0]):
                step = next(((held - total, self.size[back] - total, taker, back) for back, taker in self._places[held].items()
                             if self.size[back] < total and taker != giver and self.free[taker] <= self.free[giver]), None)
                if step is not None:
                    if best is None or step[:2] < best:
                        best, found = step[:2], (step[2], out, step[3])
                    break
                held = self._least(self._place_sizes, held + 1)
        return found

    def apply(self, giver: int, taker: int, out: tuple[int, ...], back: int | None) -> None:
        self._hide(giver)
        self._hide(taker)
        for i in out:
            self.bins[giver].remove(i)
            self.bins[taker].append(i)
        gain = sum(self.size[i] for i in out)
        if back is not None:
            self.bins[taker].remove(back)
            self.bins[giver].append(back)
            gain -= self.size[back]
        self.free[giver] += gain
        self.free[taker] -= gain
        self._show(giver)
        self._show(taker)
        self.steps["move" if back is None else "two" if len(out) == 2 else "one"] += 1

    def run(self) -> list[list[int]]:
        """The bins that are left when every underfull bin has been a giver in turn and none had a step."""
        helped = True
        while helped:
            helped, tried = False, set()
            while (giver := self._emptiest(tried)) is not None:
                tried.add(giver)
                while self.bins[giver] and (step := self.best_step(giver)):
                    self.apply(giver, *step)
                    helped = True
                self.steps["emptied"] += not self.bins[giver]
        return [b for b in self.bins if b]

    def _emptiest(self, besides: set[int]) -> int | None:
        sizes = self._room_sizes
        while sizes:
            free = sizes.bit_length() - 1
            found = next((b for b in self._rooms[free] if b not in besides), None)
            if found is not None:
                return found
            sizes &= ~(1 << free)
        return None


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD, text: str = "text",
           doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``pieces`` with sequence_id and offset: where a piece lies, gapless from 0.

    Every document ends in id 0, so null and empty texts and a text of white space are one id long. Rows that repeat are
    packed as often as they occur; a missing doc_id is kept as missing. Other columns are not read. Ties in length go by
    the order in which the pieces were written. No rows give no rows.
    """
    cut = pieces(docs, tokenizer, capacity, text, doc_id, with_ids).withColumn("number", F.monotonically_increasing_id())
    cut = support.stored(cut, "pieces")
    whole = cut.where(F.col("length") == capacity)
    part = cut.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard))
    slim = part.select("number", "length", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int").alias("shard"))

    def pack(key, rows):
        import pyarrow as pa

        order = np.argsort(rows["number"].to_numpy(), kind="stable")
        number, length = rows["number"].to_numpy()[order], rows["length"].to_numpy()[order]
        sequence, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        for at, held in enumerate(fill_bins(length, capacity)):
            sequence[held] = (key[0].as_py() << 32) + at
            offset[held] = np.cumsum(length[held]) - length[held]
        return pa.table({"number": number, "sequence_id": sequence, "offset": offset})

    support.ship(docs.sparkSession)
    placed = slim.groupBy("shard").applyInArrow(pack, "number long, sequence_id long, offset long")
    alone = whole.withColumn("sequence_id", -F.col("number") - 1).withColumn("offset", F.lit(0).cast("long"))
    return part.join(placed, "number").select(*alone.columns).unionByName(alone).drop("number")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@support.query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packed(support.table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))
