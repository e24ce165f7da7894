"""Ingestion: pages to raw rows, raw rows to chunks that know their pages; elements to chunks that know their sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import documents as D
from sparkloom.operators.scan import Machine, scanned
from sparkloom.sources.versioned import Store


@dataclass(frozen=True)
class Sizes:
    """Bytes of a chunk in UTF-8: aimed at, at least, at most; bytes that a chunk repeats of the last one."""

    # Sizes of the standard preset.
    target: int = 1200
    least: int = 300
    most: int = 2400
    overlap: int = 150

    @staticmethod
    def small() -> Sizes:
        return Sizes().scaled(1, 2)

    @staticmethod
    def large() -> Sizes:
        return Sizes().scaled(2, 1)

    def scaled(self, up: int, down: int) -> Sizes:
        return Sizes(*(x * up // down for x in (self.target, self.least, self.most, self.overlap)))

    @staticmethod
    def of_tokens(target: int = 300, most: int = 600, overlap: int = 40) -> Sizes:
        """Sizes in tokens of four bytes; the least is a quarter of the target."""
        return Sizes(4 * target, 4 * (target // 4), 4 * most, 4 * overlap)


def _whole(data: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins."""
    at = min(max(at, 0), len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def split_place(data: bytes, target: int) -> int:
    """Where to cut: behind the last blank line, else the last sentence's end, beyond half of the target; else behind the last space before it; else at the target."""
    end = _whole(data, target)
    for marks in ((b"\n\n",), (b". ",), (b"! ",), (b"? ",), (b".\n",), (b"!\n",), (b"?\n",)):
        for mark in marks:
            if (at := data.rfind(mark, 0, end)) > end // 2:
                return at + len(mark)
    if (at := data.rfind(b" ", 0, end)) >= 0:
        return at + 1
    return end or len(data)


class _Pages(Machine):
    """Pages of one item, joined by line breaks and cut into chunks."""

    def __init__(self, sizes: Sizes) -> None:
        self.sizes, self.number = sizes, 0
        self.held = b""
        self.ids: list[str] = []
        #: (first byte in ``held``, page) of each page that is in it.
        self.pages: list[tuple[int, int]] = []

    def _chunk(self, end: int) -> tuple:
        over = [p for k, (at, p) in enumerate(self.pages) if at < end]
        out = (self.number, self.held[:end].decode(), list(self.ids), over[0], over[-1])
        self.number += 1
        return out

    def take(self, page: int, raw_id: str, text: str | None) -> list[tuple]:
        data = (text or "").strip().encode()
        if not data:
            return []
        out = []
        if self.held and len(self.held) + len(data) + 1 > 2 * self.sizes.target:
            out.append(self._chunk(len(self.held)))
            self.held, self.ids, self.pages = b"", [], []
        if self.held:
            self.held += b"\n"
        self.pages.append((len(self.held), page))
        self.held += data
        self.ids.append(raw_id)
        while len(self.held) > self.sizes.target:
            cut = split_place(self.held, self.sizes.target)
            out.append(self._chunk(cut))
            begin = _whole(self.held, cut - self.sizes.overlap) if cut > self.sizes.overlap else cut
            begin = begin or cut
            self.held = self.held[begin:]
            later = [k for k, (at, _) in enumerate(self.pages) if at <= begin]
            self.pages = [(max(at - begin, 0), p) for at, p in self.pages[later[-1] :]]
        return out

    def end(self) -> list[tuple]:
        return [self._chunk(len(self.held))] if self.held and len(self.held) >= self.sizes.least else []


def page_chunks(pages: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """(item_id, chunk_index, content, source_ids, page_start, page_end) of pages (item_id, page, raw_id, text).

    Pages of an item are joined in order and cut near the target; a page that would make
    more than twice the target begins a chunk.  A chunk overlaps the one before if a page was cut.  source_ids
    are the raw ids of all pages since the last such beginning, page_start and page_end those whose
    bytes are in the chunk.  Null and blank pages give nothing; a rest under the least size is left out.
    """
    return scanned(pages, ["item_id"], ["page", "raw_id"], ["page", "raw_id", "text"], lambda: _Pages(sizes), "chunk_index int, content string, source_ids array<string>, page_start long, page_end long")


def ingest_pages(store: Store, pages: DataFrame, sizes: Sizes = Sizes()) -> tuple[int, int]:  # noqa: B008
    """(changed pages, chunks): both phases for all pages (item_id, page, text) of some items.

    First the pages that are new, changed (by hash of the text) or gone are
    committed as raw rows, and their items are marked as in process.  Then items
    in process are cut into chunks anew, in place of their old ones, and marked as ready, in one commit.  A run that dies in
    between leaves its items in process, and the next one, of whatever pages, does the second phase for them.
    The store has the tables raw (item_id, page), chunks (item_id, chunk_index) and items (item_id).
    """
    key = ["item_id", "page"]
    since = store.latest()
    raw_id = F.concat_ws("-p", "item_id", F.col("page").cast("string"))
    now = pages.select("item_id", F.col("page").cast("long").alias("page"), raw_id.alias("raw_id"), F.col("text").cast("string").alias("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    old = store.read("raw")
    changed = now if old is None else now.join(old.select(*key, "hash"), [*key, "hash"], "left_anti").select(now.columns)
    rows = store.stage(changed, "raw")
    written = store._folder(rows | {"version": 0})
    n = written.count()
    gone = None if old is None else old.join(now.select("item_id").distinct(), "item_id", "left_semi").join(now, key, "left_anti").select(*key)
    keys = written.select(*key) if gone is None else written.select(*key).unionByName(gone)
    removed = store.stage(keys, "raw", "keys")
    touched = store._folder(removed | {"version": 0}).select("item_id").distinct()
    if not touched.isEmpty():
        items = touched.select("item_id", F.lit("processing").alias("status"), F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("chunks"))
        store.commit([rows, removed, store.stage(items, "items"), store.stage(touched, "items", "keys")], since)
    return n, chunk_pending(store, sizes)


def chunk_pending(store: Store, sizes: Sizes = Sizes()) -> int:  # noqa: B008
    """The second phase for all items in process; returns the number of their chunks."""
    since = store.latest()
    items = store.read("items")
    pending = None if items is None else items.where("status = 'processing'").select("item_id")
    if pending is None or pending.isEmpty():
        return 0
    raw = store.read("raw").join(pending, "item_id", "left_semi")
    fresh = store.stage(page_chunks(raw, sizes), "chunks")
    chunks = store._folder(fresh | {"version": 0})
    counts = chunks.groupBy("item_id").agg(F.count("*").alias("chunks"))
    ready = pending.join(raw.groupBy("item_id").agg(F.count("*").alias("pages")), "item_id", "left").join(counts, "item_id", "left")
    ready = ready.select("item_id", F.lit("ready").alias("status"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    changes = [fresh, store.stage(ready, "items"), store.stage(pending, "items", "keys")]
    old = store.read("chunks")
    if old is not None:
        changes.append(store.stage(old.join(pending, "item_id", "left_semi").select("item_id", "chunk_index"), "chunks", "keys"))
    store.commit(changes, since)
    return chunks.count()


class _Elements(Machine):
    """Elements of one document: headings into a stack, atomic ones by themselves, others packed with an overlap."""

    def __init__(self, sizes: Sizes, share: float, atomic_most: float) -> None:
        self.sizes, self.overlap, self.atomic_most = sizes, int(sizes.target * share), int(sizes.most * atomic_most)
        self.path: list[str] = []
        self.held, self.page = b"", None
        self.number = 0

    def _chunk(self, data: bytes, page: int | None, kind: str) -> tuple:
        out = (self.number, data.decode().strip(), kind, [s for s in self.path if s], page)
        self.number += 1
        return out

    def _rest(self, data: bytes) -> bytes:
        """The end of a chunk that the next one repeats, from a word's beginning."""
        if not self.overlap or len(data) <= self.overlap:
            return b""
        tail = data[_whole(data, len(data) - self.overlap) :]
        return tail[tail.find(b" ") + 1 :]

    def _flush(self) -> list[tuple]:
        return [self._chunk(self.held, self.page, "text")] if self.held and len(self.held) >= self.sizes.least else []

    def take(self, level: int | None, kind: str, atomic: bool, page: int | None, text: str | None, sentences: list[str] | None) -> list[tuple]:
        if text is None:
            return []
        if level:
            out = self._flush()
            if out:
                self.held, self.page = self._rest(self.held), page
            self.path = [*self.path[: level - 1], *[""] * (level - 1 - len(self.path)), text.strip()]
            return out
        if atomic:
            out = self._flush()
            if out:
                self.held = b""
            self.page = None
            if len(text.encode()) <= self.atomic_most:
                return [*out, self._chunk(text.encode(), page, kind)]
            return out + self._split(sentences or [], page, kind)
        data, out = text.encode(), []
        self.page = page if self.page is None else self.page
        if len(self.held) + len(data) > self.sizes.most and (out := self._flush()):
            self.held = self._rest(self.held)
        self.held += (b"\n\n" if self.held else b"") + data
        if len(self.held) >= self.sizes.target:
            out.append(self._chunk(self.held, self.page, "text"))
            self.held, self.page = self._rest(self.held), page
        return out

    def _split(self, sentences: list[str], page: int | None, kind: str) -> list[tuple]:
        out, held = [], b""
        for s in sentences:
            data = s.encode()
            if len(held) + len(data) > self.sizes.most and len(held) >= self.sizes.least:
                out.append(self._chunk(held, page, kind))
                held = self._rest(held)
            held += (b" " if held and not held.endswith(b" ") else b"") + data
            if len(held) >= self.sizes.target:
                out.append(self._chunk(held, page, kind))
                held = self._rest(held)
        return out + ([self._chunk(held, page, kind)] if held and len(held) >= self.sizes.least else [])

    def end(self) -> list[tuple]:
        return self._flush()


def section_chunks(elements: DataFrame, sizes: Sizes = Sizes(), share: float = 0.12, atomic_most: float = 2.0) -> DataFrame:  # noqa: B008
    """(item_id, chunk_index, content, kind, section_path, page) of elements (item_id, place, page, text, header boolean, kind, atomic boolean).

    A heading closes the chunk before it and sets its level of the path, which the chunks behind it carry: chapters, parts and
    appendices are level 1, sections and capitals 2, others by their numbers or 3.  An
    atomic element is a chunk of its own up to ``atomic_most`` times the most bytes, else cut at sentences.  The
    others are packed; a chunk repeats a ``share`` of the target of the last one, from a word on.
    Null texts give nothing; what is under the least size waits for more or is left out at the end.
    """
    found = D.header_level(F.col("text"))
    low = F.trim(F.lower("text"))
    level = F.when(F.col("header"), F.coalesce(found, F.when(low.startswith("section"), 2).when((F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{L}"), 2).otherwise(3)))
    pieces = F.when(F.col("atomic") & (F.octet_length("text") > int(sizes.most * atomic_most)), D.sentences(F.col("text")))
    rows = elements.select("item_id", "place", F.col("page").cast("long").alias("page"), "text", level.cast("int").alias("level"), "kind", F.coalesce("atomic", F.lit(False)).alias("atomic"), pieces.alias("sentences"))
    return scanned(rows, ["item_id"], ["place"], ["level", "kind", "atomic", "page", "text", "sentences"], lambda: _Elements(sizes, share, atomic_most), "chunk_index int, content string, kind string, section_path array<string>, page long")
