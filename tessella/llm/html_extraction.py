"""Main text of web pages by markup and a suffix array of each host.

Markup gives blocks of text and says of each whether it is in the page's article, apart
from it (menus, footers, forms, adverts ...) or neither. All that the pages of a host say, inside their articles and outside, is
concatenated to one token stream with an end after each page. Its suffix array and the lengths of
common prefixes of neighbours in it give all strings of ``min_tokens`` or more that pages have in common: intervals of neighbours with such a
prefix. A string on ``min_pages`` different pages is boilerplate; pages with the same article are one page in that count, so
copies of a page don't make it boilerplate. Runs of the page's text that such strings cover are removed and the unique runs kept in page
order; a page that has no other run keeps its text. From an article that the page marks as such only whole blocks go, and only those
that at least ``strong_share`` of the host's pages have, since articles may well quote each other.

What markup does: it finds the article, drops what is apart from it and splits blocks. What the suffix array does: it finds
the repeated blocks that no markup tells of, in articles and on pages without one.

A string counts in its whole host, whatever the host's size. Small hosts share tasks. Hosts of more than ``part_bytes`` are dealt into parts of
that size by the hash of their rows; each part finds by its own suffix array what repeats in it, and the parts' counts are put together in two rounds. First
every part tells 32 bits of the hash of each string of ``min_tokens`` (sorted, as differences) with its number of pages, and hears which of them might be on enough pages in all, and
which of its articles other parts have too. Then of those strings alone it tells the whole hash, the pages that only it has as a number and articles that others have
too by name, and hears which of them are boilerplate. A part hears only of what it told, and nobody gets a whole host: strings go to buckets, one for eight parts.

Defined results: null or empty html gives an empty text; repeated rows are extracted each; a null or odd url makes its own
host; very long pages are parts of their own at most; pages that tie in everything get equal texts; other columns are ignored or kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import words as w
from .common import small_batches
from .page_markup import Page

#: Large hosts up to which their table is broadcast (a name and a number each).
BROADCAST_HOSTS = 50_000
#: Parts of a host for one bucket of its strings.
PARTS_A_BUCKET = 8
#: Pages that a string has to be on, at least, to be on most of a host's.
STRONG_PAGES = 5


def host_of(url: Column) -> Column:
    """Lower-case host of a url, an empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class Pieces(NamedTuple):
    """What a page says: pieces of text in page order, 1 for those outside the article and 0 for those inside, (block, place) of each, and
    whether the page marks its article as such."""

    texts: list[str]
    outside: list[int]
    where: list[tuple[int, int]]
    marked: bool


def _pieces(source: str) -> Pieces:
    page = Page(source)
    texts, outside, where = [], [], []
    for b, block in enumerate(page.blocks):
        for k, (text, e) in enumerate(block):
            if not text.isspace():
                texts.append(text)
                outside.append(int(page.away[e] or (page.best > 0 and not page.inside[e])))
                where.append((b, k))
    return Pieces(texts, outside, where, page.best >= 2)


def _packed(page: Pieces) -> tuple[int, bytes]:
    """A page's pieces as compressed bytes, and their size before."""
    said = [x.encode("utf-8", "surrogatepass") for x in page.texts]
    table = np.array([[len(x), o, b, k] for x, o, (b, k) in zip(said, page.outside, page.where, strict=True)], "<i4").reshape(-1, 4)
    raw = np.array([len(said), page.marked], "<i4").tobytes() + table.T.tobytes() + b"".join(said)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(size: int, packed: bytes) -> Pieces:
    raw = pa.decompress(packed, size, codec="zstd", asbytes=True)
    many, marked = np.frombuffer(raw, "<i4", 2).tolist()
    sizes, outside, block, place = np.frombuffer(raw, "<i4", 4 * many, 8).reshape(4, many).tolist()
    texts, at = [], 8 + 16 * many
    for k in sizes:
        texts.append(raw[at : at + k].decode("utf-8", "surrogatepass"))
        at += k
    return Pieces(texts, outside, list(zip(block, place, strict=True)), bool(marked))


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of a token sequence in order, and the rank of each position's first 1, 2, 4 ... tokens.

    Prefix doubling: each round ranks pairs of ranks, only for suffixes that are not told apart yet; ranks of those that are stay,
    as a rank is the number of suffixes before the first one of its kind.
    """
    size = len(tokens)
    _, number, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[number].astype(np.int64)
    levels, step = [rank], 1
    open_ = np.flatnonzero(counts[number] > 1)
    while len(open_) and step < size:
        ahead = np.where(open_ + step < size, rank[np.minimum(open_ + step, size - 1)] + 1, 0)
        order = np.lexsort((ahead, rank[open_]))
        first, second = rank[open_][order], ahead[order]
        new_class = np.append(True, first[1:] != first[:-1])
        fresh = new_class | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(order))
        within = place - np.maximum.accumulate(np.where(new_class, place, 0))  # suffixes of its old kind before it
        head = np.maximum.accumulate(np.where(fresh, place, 0))
        rank = rank.copy()
        rank[open_[order]] = first + within[head]
        many = np.bincount(np.cumsum(fresh) - 1)
        open_ = np.sort(open_[order][np.repeat(many, many) > 1])
        levels.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each suffix in order but the first, how many tokens it begins with in common with the one before."""
    size = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, size - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < size) & (b < size)
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        step = np.where(same, 1 << k, 0)
        a, b, out = a + step, b + step, out + step
    return out


def repeated_spans(tokens: np.ndarray, page: np.ndarray, like: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a string of ``min_tokens`` begins that is somewhere else too, and on how many different pages it is.

    ``tokens`` is the stream with an end of its own after each page, ``page`` the page of each token, ``like`` a number for each page that
    is equal for pages that count as one.
    """
    order, levels = suffix_array(tokens)
    joined = common_prefixes(order, levels) >= min_tokens
    interval = np.cumsum(np.append(True, ~joined)) - 1
    shared = np.append(False, joined) | np.append(joined, False)
    at, interval = order[shared], interval[shared]
    if not len(at):
        return at, at
    kind = like[page[at]]
    pairs = np.unique(np.stack([interval, kind]), axis=1)[0]
    first, many = np.unique(pairs, return_counts=True)
    return at, many[np.searchsorted(first, interval)]


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, starts = w.text_bytes(pa.array(texts, pa.large_string()))
    runs = w.Runs(data, starts)
    return runs.hash, runs.doc


def _covered(size: int, at: np.ndarray, length: int) -> np.ndarray:
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + length, size), -1)
    return np.cumsum(cover)[:-1] > 0


class Deal:
    """Pages that one task has, and their words one after the other: ``words`` (hashes), ``page`` and ``piece`` of each, and whether it is ``inside`` the article."""

    def __init__(self, pages: list[Pieces]):
        self.pages = pages
        self.said = [x for p in pages for x in p.texts]
        self.words, self.piece = _tokens(self.said)
        owner = np.repeat(np.arange(len(pages)), [len(p.texts) for p in pages])
        self.page = owner[self.piece]
        self.inside = ~np.array([x for p in pages for x in p.outside], bool)[self.piece]
        # a page's article in 64 bits, or its text where none is marked: pages of a host that have the same count as one
        self.like = np.zeros(len(pages), w.U64)
        of = self.page[self.inside]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        np.add.at(self.like, of, w.mix(self.words[self.inside] ^ w.mix(place.astype(w.U64))))
        self.like = w.mix(self.like)

    def repeats(self, like: np.ndarray, salt: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """The words at which a repeated string begins and on how many different pages it is; words of pages with another ``salt`` differ."""
        if not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.flatnonzero(np.append(self.page[1:] != self.page[:-1], True))
        at = np.arange(len(self.words)) + np.searchsorted(ends, np.arange(len(self.words)), "left")
        stream, page = np.empty(len(self.words) + len(ends), w.U64), np.empty(len(self.words) + len(ends), np.int64)
        stream[at], page[at] = w.mix(self.words ^ w.mix(salt[self.page])), self.page
        stops = at[ends] + 1
        stream[stops], page[stops] = w.mix(np.arange(len(ends), dtype=w.U64) + w.U64(1 << 63)), self.page[ends]
        begins, many = repeated_spans(stream, page, like, min_tokens)
        return np.searchsorted(at, begins), many

    def texts(self, often: np.ndarray, always: np.ndarray) -> list[str]:
        """Each page's main text: without the words that are ``often`` elsewhere, or ``always`` where the page marks its article."""
        drop: dict[int, list[str]] = {}
        if len(self.words):
            marked = np.array([p.marked for p in self.pages])[self.page]
            gone = np.where(marked, always, often)
            # of marked articles whole blocks only
            block = np.array([b for p in self.pages for b, _ in p.where])[self.piece]
            key = self.page.astype(np.int64) << 32 | block
            gone &= ~(marked & np.isin(key, np.unique(key[self.inside & marked & ~gone])))
            gone &= self.inside
            left = np.bincount(self.page, self.inside & ~gone, len(self.pages))
            gone &= (left > 0)[self.page]
            for piece in np.unique(self.piece[gone]):
                flags = gone[np.searchsorted(self.piece, piece) : np.searchsorted(self.piece, piece, "right")]
                said = w.text_bytes(pa.array([self.said[piece]], pa.large_string()))[0].tobytes().split()
                drop[int(piece)] = [x.decode() for x, out in zip(said, flags, strict=True) if not out]
        out, begin = [], 0
        for page in self.pages:
            parts: dict[int, list[str]] = {}
            last: dict[int, int] = {}
            for i, (text, outside, (b, k)) in enumerate(zip(page.texts, page.outside, page.where, strict=True), begin):
                if outside:
                    continue
                text = text if i not in drop else f" {' '.join(drop[i])} "
                gap = " " if b in last and k != last[b] + 1 else ""  # white space between pieces, or a piece left out
                parts.setdefault(b, []).append(gap + text)
                last[b] = k
            begin += len(page.texts)
            out.append(" ".join(x for x in (" ".join("".join(p).split()) for p in parts.values()) if x))
        return out


def _texts(pages: list[Pieces], hosts: list[str], min_tokens: int, min_pages: int, strong_share: float) -> list[str]:
    deal = Deal(pages)
    if not len(deal.words):
        return deal.texts(np.empty(0, bool), np.empty(0, bool))
    _, host = np.unique(np.array(hosts, object).astype(str), return_inverse=True)
    _, like = np.unique(w.mix(deal.like ^ w.mix(host.astype(w.U64) + w.U64(7))), return_inverse=True)
    begins, many = deal.repeats(like, host.astype(w.U64) + w.U64(1), min_tokens)
    pages_of_host = np.bincount(np.unique(np.stack([host, like]), axis=1)[0], minlength=int(host.max()) + 1)
    strong = many >= np.maximum(STRONG_PAGES, np.ceil(strong_share * pages_of_host[host[deal.page[begins]]]))
    return deal.texts(*(_covered(len(deal.words), begins[ok], min_tokens) for ok in (many >= min_pages, strong)))


def main_texts(sources: list[str], hosts: list[str], min_tokens: int, min_pages: int, strong_share: float) -> list[str]:
    """The main text of each page of some hosts."""
    return _texts([_pieces(x) for x in sources], hosts, min_tokens, min_pages, strong_share)


def _steps(numbers: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit differences; 65535 goes that far without giving a number."""
    step = np.diff(numbers.astype(np.int64), prepend=0)
    many = step // 65535
    out = np.full(len(step) + int(many.sum()), 65535, "<u2")
    out[np.cumsum(many + 1) - 1] = step % 65535
    return out.tobytes()


def _numbers(steps: bytes) -> np.ndarray:
    step = np.frombuffer(steps, "<u2")
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit hashes by their upper 32 bits; it grows with them."""
    return ((hashes >> w.U64(32)) * w.U64(buckets) >> w.U64(32)).astype(np.int64)


def _cuts(hashes: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Sorted hashes by bucket, as places."""
    return np.split(np.arange(len(hashes)), np.searchsorted(_bucket(hashes, buckets), np.arange(1, buckets)))


def _base(bucket: int, buckets: int) -> int:
    return (bucket << 32) // buckets


def _u64(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, w.U64), *(np.frombuffer(x, "<u8") for x in column.to_pylist())])


def _deal(table: pa.Table) -> tuple[Deal, int]:
    """A deal of a large host, and the number of the host's buckets."""
    pages = [_unpacked(size, x.as_py()) for size, x in zip(table["size"].to_pylist(), table["page"], strict=True)]
    return Deal(pages), -(-table["parts"][0].as_py() // PARTS_A_BUCKET)


_TOLD = "deal string, host string, bucket long, buckets long, steps binary, likes binary"
_HEARD = "deal string, bucket long, buckets long, steps binary, likes binary, pages long"
_COUNTED = "deal string, host string, bucket long, pages long, windows binary, many binary, windows_of binary, likes binary"
_JUDGED = "deal string, often binary, always binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _tell(table: pa.Table, min_tokens: int, need: int) -> list[tuple]:
    """For each bucket of a part's host: its strings, each as often as it is on pages here (``need`` times at most), and its articles."""
    deal, buckets = _deal(table)
    begins, many = deal.repeats(deal.like, np.zeros(len(deal.pages), w.U64), min_tokens)
    count = np.ones(len(deal.words), np.int64)
    count[begins] = many
    windows, at = w.windows(deal.words, deal.page, min_tokens)
    windows, first = np.unique(windows, return_index=True)
    windows = np.repeat(windows, np.minimum(count[at[first]], need))
    likes = np.unique(deal.like)
    where = table["deal"][0].as_py(), table["host"][0].as_py()
    upper = (windows >> w.U64(32)).astype(np.int64)
    cuts = zip(_cuts(windows, buckets), _cuts(likes, buckets), strict=True)
    return [(*where, k, buckets, _steps(upper[a] - _base(k, buckets)), likes[b].astype("<u8").tobytes()) for k, (a, b) in enumerate(cuts)]


def _hear(table: pa.Table, need: int) -> list[tuple]:
    """For each part: which of its strings might be on ``need`` pages, which of its articles are elsewhere too, and how many articles there are."""
    told = [_numbers(x) for x in table["steps"].to_pylist()]
    number, count = np.unique(np.concatenate(told), return_counts=True)
    number = number[count >= need]
    likes, count = np.unique(_u64(table["likes"]), return_counts=True)
    out = []
    for i, (deal, mine) in enumerate(zip(table["deal"].to_pylist(), told, strict=True)):
        held = np.frombuffer(table["likes"][i].as_py(), "<u8")
        out.append((deal, table["bucket"][i].as_py(), table["buckets"][i].as_py(), _steps(np.intersect1d(mine, number)), np.intersect1d(held, likes[count > 1]).astype("<u8").tobytes(), len(likes)))
    return out


def _count(table: pa.Table, heard: pa.Table, min_tokens: int) -> list[tuple]:
    """For each bucket: a part's strings that might be on enough pages, with the number of those whose article is nowhere else, and with the other articles."""
    deal, buckets = _deal(table)
    windows, at = w.windows(deal.words, deal.page, min_tokens)
    rows = zip(heard["steps"].to_pylist(), heard["bucket"].to_pylist(), strict=True)
    wanted = np.concatenate([np.empty(0, np.int64), *(_numbers(x) + _base(k, buckets) for x, k in rows)])
    mine = np.isin((windows >> w.U64(32)).astype(np.int64), wanted)
    windows, like = windows[mine], deal.like[deal.page[at[mine]]]
    order = np.lexsort((like, windows))
    windows, like = windows[order], like[order]
    fresh = np.append(True, (windows[1:] != windows[:-1]) | (like[1:] != like[:-1]))[: len(windows)]
    windows, like = windows[fresh], like[fresh]
    spread = np.isin(like, _u64(heard["likes"]))
    window, many = np.unique(windows[~spread], return_counts=True)
    pages = sum(heard["pages"].to_pylist())
    where = table["deal"][0].as_py(), table["host"][0].as_py()
    cuts = zip(_cuts(window, buckets), _cuts(windows[spread], buckets), strict=True)
    found = [(k, window[a], many[a].astype(w.U64), windows[spread][b], like[spread][b]) for k, (a, b) in enumerate(cuts) if len(a) or len(b)]
    return [(*where, k, pages, *(x.astype("<u8").tobytes() for x in arrays)) for k, *arrays in found]


def _judge(table: pa.Table, min_pages: int, strong_share: float) -> list[tuple]:
    """For each part: which of its strings are on ``min_pages`` pages of the host, and which on most of them."""
    pairs = np.unique(np.stack([_u64(table["windows_of"]), _u64(table["likes"])]), axis=1)[0]
    window, of = np.unique(np.concatenate([_u64(table["windows"]), pairs]), return_inverse=True)
    count = np.zeros(len(window), np.int64)
    np.add.at(count, of, np.concatenate([_u64(table["many"]).astype(np.int64), np.ones(len(pairs), np.int64)]))
    strong = count >= max(STRONG_PAGES, np.ceil(strong_share * table["pages"][0].as_py()))
    out = []
    for i, deal in enumerate(table["deal"].to_pylist()):
        mine = np.union1d(*(np.frombuffer(table[c][i].as_py(), "<u8") for c in ("windows", "windows_of")))
        out.append((deal, *(np.intersect1d(mine, window[ok]).astype("<u8").tobytes() for ok in (count >= min_pages, strong))))
    return out


def extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), url_col: str = "url", html_col: str = "html", min_tokens: int = 8, min_pages: int = 3, strong_share: float = 0.5, part_bytes: int = 2 << 20) -> DataFrame:
    """Columns ``keep`` in the struct ``row``, and the main ``text`` of each page."""
    row = F.struct(*(F.col(c) for c in keep)).alias("row")
    read = small_batches(pages).select(row, host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sizes = read.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    large = sizes.where(F.col("bytes") > part_bytes).select("host", F.ceil(F.col("bytes") / part_bytes).alias("parts"))
    few = large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = read.join(F.broadcast(large) if few else large, "host", "left")
    own = F.concat_ws("#", "host", F.pmod(F.xxhash64("row", "html"), F.col("parts")).cast("string"))
    shared = F.concat(F.lit("##"), F.pmod(F.xxhash64("host"), F.lit(1 + total // part_bytes)).cast("string"))
    dealt = joined.select("row", "html", "host", "parts", F.coalesce(F.when(F.col("parts").isNotNull(), own), shared).alias("deal"))


    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in w.slices(batch, "html"):
                packed = [_packed(_pieces(x)) for x in piece["html"].to_pylist()]
                sizes, pages = pa.array([n for n, _ in packed], pa.int64()), pa.array([x for _, x in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([*(piece[c] for c in ("row", "deal", "host", "parts")), sizes, pages], names)

    kinds = StructType([*(dealt.schema[c] for c in ("row", "deal", "host", "parts")), StructField("size", LongType()), StructField("page", BinaryType())])
    names = kinds.names
    parsed = dealt.mapInArrow(parse, kinds).groupBy("deal")
    # a string counts from two pages on
    min_pages = max(2, min_pages)
    need = min(min_pages, STRONG_PAGES)

    def tell(key, table):
        rows = _tell(table, min_tokens, need) if table["parts"][0].is_valid else []
        w.trim()
        return _rows(_TOLD, rows)

    def count(key, table, heard):
        rows = _count(table, heard, min_tokens) if table["parts"][0].is_valid else []
        w.trim()
        return _rows(_COUNTED, rows)

    told = parsed.applyInArrow(tell, _TOLD)
    heard = told.groupBy("host", "bucket").applyInArrow(lambda key, table: _rows(_HEARD, _hear(table, need)), _HEARD)
    counted = parsed.cogroup(heard.groupBy("deal")).applyInArrow(count, _COUNTED)
    judged = counted.groupBy("host", "bucket").applyInArrow(lambda key, table: _rows(_JUDGED, _judge(table, min_pages, strong_share)), _JUDGED)

    def run(key, table, judged):
        if table["parts"][0].is_valid:
            deal, _ = _deal(table)
            windows, at = w.windows(deal.words, deal.page, min_tokens)
            texts = deal.texts(*(_covered(len(deal.words), at[np.isin(windows, _u64(judged[c]))], min_tokens) for c in ("often", "always")))
        else:
            pages = [_unpacked(size, x.as_py()) for size, x in zip(table["size"].to_pylist(), table["page"], strict=True)]
            texts = _texts(pages, table["host"].to_pylist(), min_tokens, min_pages, strong_share)
        w.trim()
        return pa.table([table["row"].combine_chunks(), pa.array(texts, pa.string())], ["row", "text"])

    return parsed.cogroup(judged.groupBy("deal")).applyInArrow(run, StructType([dealt.schema["row"], StructField("text", StringType())]))
