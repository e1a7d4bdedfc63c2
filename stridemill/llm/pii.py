"""Personal data in segment texts: base patterns, and a character tagger that adds to them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.batches import bound_batches
from stridemill.llm.tagger import KINDS, Tagger, symbols
from stridemill.llm.words import mixed
from stridemill.scale import top_rows

WINDOW, STRIDE = 96, 48
TRAIN_ROWS, TRAIN_WINDOWS, WINDOWS_PER_TEXT, EPOCHS = 400, 720, 6, 26
CONFIDENCE = 0.5
DRAW_PARTS = 256
BATCH_WINDOWS = 256

Span = tuple[int, int, str]

# the leftmost matches of the fixed base patterns, written so that no text takes more than linear time
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a span always holds: a digit, or an at sign in one of its spellings.
MARK = r"[0-9@\uFF20]|\((?:at|AT)\)|\[(?:at|AT)\]"
_MARK = re.compile(MARK)
_AT = re.compile(r"@|\uFF20|\((?:at|AT)\)|\[(?:at|AT)\]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    spans = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            spans.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            spans.append((*m.span(), "phone"))
    return spans


def _tagged(size: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(size, np.int8)
    for start, end, kind in reversed(spans):
        tags[start] = 1 + 2 * KINDS.index(kind)
        tags[start + 1 : end] = 2 + 2 * KINDS.index(kind)
    return tags


def _places(text: str) -> list[int]:
    """Starts of the windows that hold a digit or ``@``; no other window can hold a span."""
    last = max(0, len(text) - WINDOW)
    grid = {0 if last == 0 else min(k * STRIDE, last) for m in _MARK.finditer(text) for k in ((m.start() // STRIDE) - 1, m.start() // STRIDE) if k >= 0}
    return sorted(grid)


def _windows(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), np.int8)
    for row, s in zip(out, starts, strict=True):
        part = codes[s : s + WINDOW]
        row[: len(part)] = part
    return out


# where a text may hold a base span, cheap enough for every row
_HINTS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9]([ -]?[0-9]){12}",
    "phone": r"\+[0-9][ ().0-9-]{6}",
}


def _number(rng: np.random.Generator, size: int) -> str:
    return "".join(map(str, rng.integers(0, 10, size)))


def _word(rng: np.random.Generator) -> str:
    return "".join(rng.choice(list("aeioubcdfghklmnprstvwz"), int(rng.integers(3, 9))))


def _card(rng: np.random.Generator) -> str:
    digits = _number(rng, int(rng.integers(13, 20)) - 1)
    return digits + next(d for d in "0123456789" if luhn(digits + d))


def _cut(digits: str, size: int, mark: str) -> str:
    return mark.join(digits[i : i + size] for i in range(0, len(digits), size))


def disguised(kind: str, rng: np.random.Generator) -> str:
    """An invented value of a kind in a spelling that its base pattern misses."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    if kind == "email":
        name, host, end = pick(_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{_number(rng, 2)}"), _word(rng), pick("com", "org", "net", "de")
        at = pick(" @ ", "@ ", "\uff20", " (at) ", "(at)", "[at]")
        return f"{name}{at}{host}.{end}"
    if kind == "ip":
        return pick(" . ", "[.]", "(.)", ". ", " .").join(str(int(rng.integers(0, 256))) for _ in range(4))
    if kind == "card":
        return _cut(_card(rng), 4, pick(".", "/", "_", " - "))
    digits = str(int(rng.integers(10, 99))) + _number(rng, int(rng.integers(8, 11)))
    if rng.random() < 0.5:
        return pick("+ ", "\uff0b", "00 ") + pick(_cut(digits, 3, " "), _cut(digits, 4, "-"), _cut(digits, 3, "/"))
    return f"({_number(rng, 3)}) {_number(rng, 4)}{pick('-', ' ', '/')}{_number(rng, 4)}"


def decoy(rng: np.random.Generator) -> str:
    """Digits or an at sign that are no personal data: versions, dates, times, prices, hex, numbers, mentions."""
    number = lambda low, high: str(int(rng.integers(low, high)))
    bad = _card(rng)
    bad = bad[:-1] + str((int(bad[-1]) + 1 + int(rng.integers(8))) % 10)
    kinds = (
        lambda: "v" + ".".join(number(0, 30) for _ in range(3)), lambda: ".".join(number(256, 2000) for _ in range(4)),
        lambda: f"20{number(10, 30)}-{number(10, 13)}-{number(10, 29)}", lambda: f"{number(10, 24)}:{number(10, 60)}",
        lambda: f"{number(1, 900)}.{number(10, 99)}", lambda: rng.bytes(10).hex(), lambda: bad, lambda: _cut(bad, 4, " "),
        lambda: number(1, 10**6), lambda: f"{number(1900, 2030)}", lambda: f"{_word(rng)} @ {_word(rng)}", lambda: f"@{_word(rng)}",
        lambda: f"{number(1, 99)} {number(1, 99)} {number(1, 99)}", lambda: f"{number(1, 9)}/{number(1, 9)}",
    )
    return kinds[int(rng.integers(len(kinds)))]()


def _drawn_windows(segments: DataFrame, id_column: str, rows: int, per_text: int) -> list[tuple[str, list[Span]]]:
    """At most ``per_text`` windows of each of ``rows`` texts: a fifth of the texts per kind, a fifth with other digits.

    Texts and windows are the smallest by hash, over whole texts, windows with a span of the text's kind first. Tasks send
    the driver hashes, then windows, never texts.
    """
    draw = F.xxhash64(F.lit("tagger"), id_column, "text")
    kind = F.lit("other")
    for name, hint in reversed(_HINTS.items()):
        kind = F.when(F.col("text").rlike(hint), name).otherwise(kind)
    marked = segments.filter(F.col("text").rlike("[0-9@]"))
    labelled = marked.select("text", draw.alias("_draw"), kind.alias("_kind"))
    most = max(1, rows // (len(KINDS) + 1))
    # in parts first, as one kind may hold most rows
    parted = labelled.select("_draw", "_kind", F.pmod("_draw", F.lit(DRAW_PARTS)).alias("_part")).distinct()
    few = top_rows(top_rows(parted, ["_kind", "_part"], [F.col("_draw")], most, "_r").drop("_r"), ["_kind"], [F.col("_draw")], most, "_r")
    chosen = [r["_draw"] for r in few.select("_draw").collect()]
    if not chosen:
        return []
    texts = labelled.filter(F.col("_draw").isin(chosen)).dropDuplicates(["_draw"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {"draw": [], "window": [], "spans": []}
            for text, seed, kind in zip(frame["text"], frame["_draw"].tolist(), frame["_kind"], strict=True):
                spans = base_spans(text)
                mine = {s // STRIDE for s, _, k in spans if k == kind}
                places = np.array(_places(text))
                order = np.argsort(mixed(places.astype(np.uint64) ^ np.uint64(seed & (1 << 64) - 1)), kind="stable")
                first = [p for p in places[order].tolist() if p // STRIDE in mine or p // STRIDE + 1 in mine]
                rest = [p for p in places[order].tolist() if p not in set(first)]
                taken = 0
                for s in [*first[: per_text // 2 or 1], *rest, *first[per_text // 2 or 1 :]]:
                    end = min(len(text), s + WINDOW)
                    if taken < per_text and not any(a < s < b or a < end < b for a, b, _ in spans):  # half a span teaches the wrong thing
                        inside = [{"start": a - s, "end": b - s, "kind": k} for a, b, k in spans if s <= a and b <= end]
                        out["draw"].append(seed)
                        out["window"].append(text[s:end])
                        out["spans"].append(inside)
                        taken += 1
            yield pd.DataFrame(out)

    found = texts.mapInPandas(cut, "draw long, window string, spans array<struct<start:int,end:int,kind:string>>").collect()
    return sorted((r["window"], [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in found)


def train_tagger(
    segments: DataFrame, id_column: str = "segment_id", rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS,
    per_text: int = WINDOWS_PER_TEXT,
) -> Tagger | None:
    """Fit on labelled spans in at most ``windows`` windows, from at most ``rows`` texts and ``per_text`` windows of each.

    A third are windows of the texts as they are, labelled with their base spans. The others put invented values between words
    of the texts, by turns personal data in a spelling that the base patterns miss, labelled so, and a decoy without a
    label. The sample that reaches the driver is bounded at any input size and the same on every
    run. None for an empty table, or when no text holds a digit or ``@``.
    """
    drawn = _drawn_windows(segments, id_column, rows, per_text)
    if not drawn:
        return None
    rng = np.random.default_rng(7)
    examples: list[tuple[str, list[Span]]] = []
    order = rng.permutation(len(drawn))
    examples += [drawn[i] for i in order[: windows // 3]]
    prose = [w for window, _ in drawn for w in window.split() if not _MARK.search(w)] or ["and"]
    turn = 0
    while len(examples) < windows:
        text, spans = "", []
        while len(text) < WINDOW:
            at = int(rng.integers(len(prose)))
            text += " ".join(prose[at : at + int(rng.integers(1, 5))]) + (" " if rng.random() < 0.9 else ", ")
            kind = KINDS[turn // 2 % len(KINDS)] if turn % 2 else None
            value = disguised(kind, rng) if kind else decoy(rng)
            turn += 1
            if len(text) + len(value) > WINDOW:
                break
            spans += [(len(text), len(text) + len(value), kind)] if kind else []
            text += value + (" " if rng.random() < 0.8 else rng.choice([", ", ". ", "\n", "; "]))
        examples.append((text[:WINDOW], spans))
    codes = np.stack([_windows(symbols(t), [0])[0] for t, _ in examples]).astype(np.int64)
    tags = np.stack([np.pad(_tagged(len(t), sorted(spans)), (0, WINDOW - len(t))) for t, spans in examples]).astype(np.int64)
    tagger = Tagger.new()
    tagger.fit(codes, tags, epochs)
    return tagger


def _decoded(tagger: Tagger, texts: list[str]) -> list[list[tuple[float, int, int, str]]]:
    """Scored spans of every text from its windows, before reconciliation."""
    found: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    queue: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        if not queue:
            return
        x = np.stack([w for _, _, w in queue]).astype(np.int64)
        emissions = tagger.emissions(x)
        tags = tagger.decode(emissions)
        hits = np.flatnonzero(tags.any(1))
        if len(hits):
            probabilities = tagger.marginals(emissions[hits])[1]
            for k, row in enumerate(hits):
                owner, base, _ = queue[row]
                path, size = tags[row], min(WINDOW, len(texts[owner]) - base)
                for start in np.flatnonzero(path % 2 == 1):
                    end = start + 1
                    while end < size and path[end] == path[start] + 1:
                        end += 1
                    sure = float(probabilities[k, np.arange(start, end), path[start:end]].min()) if end <= size else 0.0
                    open_front, open_back = start == 0 and base > 0, end == size and base + size < len(texts[owner])
                    if not (open_front or open_back) and sure >= CONFIDENCE:
                        found[owner].append((sure, base + int(start), base + int(end), KINDS[path[start] // 2]))
        queue.clear()

    for i, text in enumerate(texts):
        if not _MARK.search(text):
            continue
        codes = symbols(text)
        for s in _places(text):
            queue.append((i, s, _windows(codes, [s])[0]))
            if len(queue) == BATCH_WINDOWS:
                flush()
    flush()
    return found


def plausible(value: str, kind: str) -> bool:
    """Whether an added span holds what its kind needs, whatever its spelling."""
    digits = "".join(_DIGIT.findall(value))
    if kind == "email":
        return len(_AT.findall(value)) == 1
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def reconciled(text: str, base: list[Span], scored: list[tuple[float, int, int, str]]) -> list[Span]:
    """Spans to add: the surest first, none that meets a base span or one already added."""
    taken = [(a, b) for a, b, _ in base]
    added: list[Span] = []
    for _, start, end, kind in sorted(set(scored), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        if not plausible(text[start:end], kind):
            continue
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            added.append((start, end, kind))
    return added


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    scored = _decoded(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, more in zip(texts, scored, strict=True):
        base = base_spans(text)
        out.append((base, reconciled(text, base, more)))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by their kinds; spans that overlap count as one."""
    parts, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_personal_data(segments: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Adds ``base_spans``, ``added_spans`` and ``clean_text`` to ``segments``.

    Spans are arrays of (kind, start, end), code points with the end exclusive, sorted by kind and
    start; the whole ``text`` is read. Base spans of one kind never overlap. The tagger reads overlapping windows; a
    span cut by a window's edge is left to its neighbour, and the windows' spans are reconciled over the
    whole text; an added span must be ``plausible``. A span always holds what ``MARK`` matches, so windows and texts
    without it are skipped. A text is read whole, in one task, with windows in batches of ``BATCH_WINDOWS``. ``clean_text``
    has every span replaced by its kind in brackets. Null and empty texts have no spans and stay as they are. A
    tagger of None (nothing to learn from) adds nothing. Columns of the same names are replaced.
    """
    shared = segments.sparkSession.sparkContext.broadcast(tagger)
    span = "array<struct<kind:string,start:long,end:long>>"

    @F.pandas_udf(f"base_spans {span}, added_spans {span}, clean_text string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        listed = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0]))]
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            rows = all_spans(shared.value, texts)
            yield pd.DataFrame({
                "base_spans": [listed(b) for b, _ in rows], "added_spans": [listed(a) for _, a in rows],
                "clean_text": [redacted(t, b + a) if b or a else None for t, (b, a) in zip(texts, rows, strict=True)],
            })

    bound_batches(segments.sparkSession)
    marked = F.when(F.col("text").rlike(MARK), F.col("text"))
    out = segments.withColumn("_found", found(marked))
    return out.withColumns({
        "base_spans": F.col("_found.base_spans"), "added_spans": F.col("_found.added_spans"),
        "clean_text": F.coalesce("_found.clean_text", "text"),
    }).drop("_found")
