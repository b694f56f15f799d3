"""Languages of documents and of their segments, by a byte convolutional network in numpy.

Bytes of a window are embedded; filters of several widths run over them, the largest response of each filter feeds a softmax
over seven languages. A window is a fixed number of whole words, and a filter sees the bytes of one word and the blanks around
it, never two words; so the largest responses inside a word are the same wherever it stands, are worked out once for each word
that a task meets, and the pooling of a window is the maximum over its words. The network is trained on the documents
themselves: of those whose label names one of the languages, at most TRAIN_DOCS per language are drawn by hash (the documented
bound of the sample), a first pass finds labels that it contradicts, and the passes after it leave those documents out. Only
these samples reach the driver; the weights are about 20 KB and go to the tasks with the function.

Applying it covers whole texts: code, tables, addresses and figures are set aside, hyphenated and wrapped lines are joined, and
each sentence is covered with windows. A best path over the sentences, with a price for each change, gives the segments; a
single sentence in another language is a quotation and joins its surroundings. A segment has at least two sentences. The
confidence is the mean probability of the language over the windows of the segment.

Null, empty and word-less texts give no row. Null doc_ids are left out; repeated doc_ids are separate texts.
"""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quern.llm.langwords import LANGUAGES, label_language, word_scores
from quern.session import spread

#: Words of a window.
WINDOW = 18
EMBED = 12
WIDTHS = (2, 3, 4)
FILTERS = 32
WIDE = FILTERS * len(WIDTHS)
#: Documents of each language that the network is fitted on, at most, and sentences of each.
TRAIN_DOCS = 500
TRAIN_SENTENCES = 6
EPOCHS = 3
#: Log probability that a change of language costs.
CHANGE = 3.0
SEED = 11
#: Words and their bytes that a task keeps the responses of; beyond, it starts anew.
KEPT_WORDS, KEPT_BYTES = 200_000, 1 << 25

_FENCE = re.compile(r"^\s*(```|~~~).*?^\s*\1[^\n]*$", re.S | re.M)
_CODE = re.compile(r"`[^`\n]*`")
_ADDRESS = re.compile(r"https?://\S+|(?<!\S)[^\s@]+@\S+")
_TAG = re.compile(r"<[^<>\n]*>")
_FIGURE = re.compile(r"\b(?=\w{6})[^\W\d]*\d\w*")
_QUOTED = re.compile(r"[\"“«„][^\"“”«»„\n]{1,40}[\"”»“]")
_DIGIT = re.compile(r"\d")
_LETTERED = re.compile(r"\w")
_LETTER_END = re.compile(r"[^\W\d_][-¬\u00ad]$")
_END = re.compile(r"[.!?…][\"'»)\]]*\s+(?=[\"'«(¿¡]?[^\W\d_a-zà-öø-ÿ])")
#: UTF-8 that was read as Latin-1.
_MISREAD = re.compile("[\u00c2\u00c3][\u0080-\u00bf]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’·][^\W\d_]+)*")


def tokens(sentence: str) -> list[str]:
    """What the network sees of a sentence: its words in small letters."""
    if not sentence.isascii():
        if not unicodedata.is_normalized("NFKC", sentence):
            sentence = unicodedata.normalize("NFKC", sentence)
        return _TOKEN.findall(unicodedata.normalize("NFC", sentence.lower()).replace("’", "'"))
    return _TOKEN.findall(sentence.lower())


def _paragraphs(text: str) -> Iterator[str]:
    """Lines with letters or digits that aren't rows of tables; a word that a hyphen broke and a line that goes on with a small
    letter are joined to the line ahead."""
    held, gap = "", False
    for line in text.split("\n"):
        line = line.strip()
        if not line or line[0] == "|" or not _LETTERED.search(line):
            gap = True
            continue
        first = line[0]
        if held and first.isalpha() and _LETTER_END.search(held):
            held = held[:-1] + line
        elif held and not gap and held[-1] not in ".!?:;…" and (first == "(" or first.islower()):
            held += " " + line
        else:
            if held:
                yield held
            held = line
        gap = False
    if held:
        yield held


def pieces(text: str) -> list[tuple[str, list[str]]]:
    """(sentence, its words) of a text without code, tables, addresses and figures; a piece of under three words of two letters
    joins the one before it. Each step is linear in the text."""
    if "\u00c3" in text or "\u00c2" in text:
        text = _MISREAD.sub(lambda m: m[0].encode("latin-1").decode("utf-8"), text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _CODE.sub(" ", text)
    if "://" in text or "@" in text:
        text = _ADDRESS.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if _DIGIT.search(text):
        text = _FIGURE.sub(" ", text)
    if '"' in text or "“" in text or "«" in text or "„" in text:
        text = _QUOTED.sub(" ", text)
    out: list[tuple[str, list[str]]] = []
    ahead, ahead_words = "", []
    for paragraph in _paragraphs(text):
        at = 0
        for m in [*_END.finditer(paragraph), None]:
            piece = paragraph[at : m.start() + 1] if m else paragraph[at:]
            at = m.end() if m else at
            own = tokens(piece)
            if len(own) < 3 or sum(len(w) > 1 for w in own[:8]) < 3 and sum(len(w) > 1 for w in own) < 3:
                if out and own:
                    out[-1] = f"{out[-1][0]} {piece}", out[-1][1] + own
                elif own:
                    ahead, ahead_words = f"{ahead} {piece}".strip(), ahead_words + own
                continue
            out.append((f"{ahead} {piece}".strip(), ahead_words + own))
            ahead, ahead_words = "", []
    return out or ([(ahead, ahead_words)] if any(len(w) > 1 for w in ahead_words) else [])


def sentences(text: str) -> list[str]:
    return [piece for piece, _ in pieces(text)]


def windows_of(n: int) -> list[tuple[int, int]]:
    """(first word, end) of the windows that cover n words, spread evenly."""
    if n <= WINDOW:
        return [(0, n)]
    k = -(-n // WINDOW)
    return [(j * (n - WINDOW) // (k - 1), j * (n - WINDOW) // (k - 1) + WINDOW) for j in range(k)]


def _bytes(word: str) -> bytes:
    return f" {word} ".encode().ljust(max(WIDTHS), b"\0")


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of size[i] numbers, for all i."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class ByteCnn:
    """Embedding, filters of several widths, largest response over a window, softmax; fitted by Adam."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
        self.p["b"] = np.zeros(WIDE, dtype=np.float32)
        self.p["out"] = rng.normal(0, (1 / WIDE) ** 0.5, (WIDE, len(LANGUAGES))).astype(np.float32)
        self.p["bias"] = np.zeros(len(LANGUAGES), dtype=np.float32)

    def responses(self, data: np.ndarray, first: np.ndarray, size: np.ndarray):
        """Largest response of each filter over words that lie end to end in data, and for each width the places tried."""
        embedded = self.p["embed"][data].ravel()
        best = np.empty((len(first), WIDE), dtype=self.p["b"].dtype)
        tried = []
        for k, w in enumerate(WIDTHS):
            inside = size - w + 1
            at = _ragged(first, inside)
            response = np.lib.stride_tricks.sliding_window_view(embedded, w * EMBED)[at * EMBED] @ self.p[f"w{w}"]
            starts = np.cumsum(inside) - inside
            best[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(response, starts, axis=0) if len(starts) else 0
            tried.append((at, response, starts, inside))
        return best, tried

    def words(self, words: list[str]) -> np.ndarray:
        """Largest response of each filter inside each word."""
        data = [_bytes(w) for w in words]
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        return self.responses(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(size) - size, size)[0]

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        """Log probabilities of windows, by the largest responses over their words."""
        z = np.maximum(pooled + self.p["b"], 0) @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _gradients(self, ids: np.ndarray, y: np.ndarray, vocabulary, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """ids: words of each window, -1 behind its end. vocabulary: (bytes of all words, first, size)."""
        data, first, size = vocabulary
        own, place = np.unique(ids, return_inverse=True)
        place = place.reshape(ids.shape)
        if own[0] < 0:
            own, place = own[1:], place - 1
        own_size = size[own]
        local = data[_ragged(first[own], own_size)]
        best, tried = self.responses(local, np.cumsum(own_size) - own_size, own_size)
        spread = np.vstack([best, np.full((1, WIDE), -1e9, dtype=best.dtype)])[place]  # -1 is the row of no word
        winner = spread.argmax(axis=1)
        pooled = np.take_along_axis(spread, winner[:, None], axis=1)[:, 0] + self.p["b"]
        mask = (rng.random(pooled.shape) > 0.3).astype(np.float32) / 0.7
        active = np.maximum(pooled, 0) * mask
        z = active @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        d = (dz @ self.p["out"].T) * mask * (pooled > 0)
        g = {"out": active.T @ dz, "bias": dz.sum(axis=0), "b": d.sum(axis=0)}
        word = np.take_along_axis(place, winner, axis=1)  # of each window and filter
        by_word = np.bincount((word * WIDE + np.arange(WIDE)).ravel(), weights=d.ravel(), minlength=len(own) * WIDE).reshape(len(own), WIDE)
        d_embed = np.zeros(256 * EMBED)
        view = self.p["embed"][local].ravel()
        for k, w in enumerate(WIDTHS):
            at, response, starts, inside = tried[k]
            part = by_word[:, k * FILTERS : (k + 1) * FILTERS]
            owner = np.repeat(np.arange(len(own)), inside)
            top, filter_ = np.nonzero((response == best[owner, k * FILTERS : (k + 1) * FILTERS]) & (part[owner] != 0))
            weight = part[owner[top], filter_].astype(np.float32)
            order = np.argsort(filter_, kind="stable")
            top, filter_, weight = top[order], filter_[order], weight[order]
            patches = np.lib.stride_tricks.sliding_window_view(view, w * EMBED)[at[top] * EMBED]
            g[f"w{w}"] = np.zeros_like(self.p[f"w{w}"])
            if len(top):
                there, cuts = np.unique(filter_, return_index=True)
                g[f"w{w}"][:, there] = np.add.reduceat(patches * weight[:, None], cuts, axis=0).T
                back = (weight[:, None] * self.p[f"w{w}"].T[filter_]).reshape(len(top), w, EMBED)
                cells = local[at[top][:, None] + np.arange(w)].astype(np.int64)[:, :, None] * EMBED + np.arange(EMBED)
                d_embed += np.bincount(cells.ravel(), weights=back.ravel(), minlength=256 * EMBED)
        g["embed"] = d_embed.reshape(256, EMBED)
        return g

    def fit(self, ids: np.ndarray, y: np.ndarray, vocabulary, epochs: int, seed: int = SEED, rate: float = 6e-3, batch: int = 128) -> "ByteCnn":
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, max(1, epochs * -(-len(ids) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for i in range(0, len(ids), batch):
                part = order[i : i + batch]
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in self._gradients(ids[part], y[part], vocabulary, rng).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


class _Index(dict):
    """Numbers of words, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Reader:
    """Scores of sentences, with the responses of the words that were met. A word list's scores may stand beside them."""

    def __init__(self, model: ByteCnn | None):
        self.model = model
        self._anew()

    def _anew(self) -> None:
        self.index, self.rows, self.kept = _Index(), 0, 0
        self.table = np.empty((1024, WIDE + len(LANGUAGES)), dtype=np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if self.rows > KEPT_WORDS or self.kept > KEPT_BYTES:
            self._anew()
        out = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.index) > self.rows:
            new = list(self.index)[self.rows :] if self.rows == 0 else [w for w, i in zip(reversed(self.index), range(len(self.index) - self.rows))][::-1]
            while len(self.table) < len(self.index):
                self.table = np.vstack([self.table, np.empty_like(self.table)])
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                rows = slice(self.rows + i, self.rows + i + len(part))
                if self.model is not None:
                    self.table[rows, :WIDE] = self.model.words(part)
                self.table[rows, WIDE:] = [word_scores(w) for w in part]
            self.rows = len(self.index)
            self.kept += sum(map(len, new))
        return out

    def read(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit of words: the sum of the log probabilities of its windows, the mean of their probabilities, and the
        scores of a word list."""
        total, mean, listed = (np.zeros((len(units), len(LANGUAGES))) for _ in range(3))
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        numbers = self._numbers([w for u in units for w in u])
        there = np.flatnonzero(size)
        if not len(there):
            return total, mean, listed
        first = (np.cumsum(size) - size)[there]
        size = size[there]
        for i in range(0, len(there), 2048):
            n, f = size[i : i + 2048], first[i : i + 2048]
            listed[there[i : i + 2048]] = np.add.reduceat(self.table[numbers[f[0] : f[-1] + n[-1]], WIDE:], f - f[0], axis=0)
        if self.model is None:
            return total, mean, listed
        count = -(-size // WINDOW)
        step = _ragged(np.zeros(len(size), dtype=np.int64), count)
        last = np.maximum(size - WINDOW, 0)
        owner = np.repeat(np.arange(len(size)), count)
        start = first[owner] + step * last[owner] // np.maximum(count - 1, 1)[owner]
        length = np.minimum(size, WINDOW)[owner]
        for i in range(0, len(start), 2048):
            n = length[i : i + 2048]
            at = numbers[_ragged(start[i : i + 2048], n)]
            each = self.model.softmax(np.maximum.reduceat(self.table[at, :WIDE], np.cumsum(n) - n, axis=0))
            to = there[owner[i : i + 2048]]
            np.add.at(total, to, np.maximum(each, -12))
            np.add.at(mean, to, np.exp(each))
        mean[there] /= count[:, None]
        return total, mean, listed


def _worn(sentence: list[str], rng: np.random.Generator) -> list[str]:
    """At times without its accents, as scanned texts come."""
    if rng.random() < 0.2:
        return ["".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in sentence]
    return sentence


def train(samples: list[tuple[list[str], str]], epochs: int = EPOCHS) -> ByteCnn:
    """A network for samples of (sentences of a document, language). Documents that the first pass contradicts are left out
    of the others."""
    rng = np.random.default_rng(SEED)
    index = _Index()
    data, label, doc = [], [], []
    for i, (own, lang) in enumerate(samples):
        for sentence in own:
            ws = _worn(tokens(sentence), rng)
            for a, b in windows_of(len(ws))[:2]:
                if b > a:
                    data.append([index[w] for w in ws[a:b]])
                    label.append(LANGUAGES.index(lang))
                    doc.append(i)
    model = ByteCnn()
    if not data:
        return model
    raw = [_bytes(w) for w in index]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    vocabulary = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size) - size, size
    ids = np.full((len(data), WINDOW), -1, dtype=np.int64)
    for row, own in zip(ids, data):
        row[: len(own)] = own
    y, doc = np.array(label), np.array(doc)
    model.fit(ids, y, vocabulary, 1)
    names = list(index)
    sums = np.zeros((len(samples), len(LANGUAGES)))
    np.add.at(sums, doc, Reader(model).read([[names[k] for k in own] for own in data])[0])
    agreed = sums.argmax(axis=1)[doc] == y
    if agreed.mean() < 0.5:  # the first pass learnt nothing: keep everything
        agreed[:] = True
    return ByteCnn().fit(ids[agreed], y[agreed], vocabulary, epochs)


def drawn_sentences(text: str, seed: int) -> list[str]:
    own = sentences(text)
    return [own[k] for k in np.random.default_rng(abs(seed)).permutation(len(own))[:TRAIN_SENTENCES]]


@pandas_udf(StringType())
def _label(values: pd.Series) -> pd.Series:
    known = {v: label_language(v) for v in values.dropna().unique()}
    return values.map(known).astype(object).where(values.notna(), None)


def draw_samples(docs: DataFrame, per_language: int = TRAIN_DOCS) -> list[tuple[list[str], str]]:
    """(sentences, language) of at most per_language labelled texts of each language, drawn by hash of doc_id, with
    TRAIN_SENTENCES sentences from anywhere in each; two jobs."""
    labelled = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), _label(docs["lang"]).alias("language")).where("language is not null and length(text) >= 60")
    counts = {r["language"]: r["count"] for r in labelled.groupBy("language").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("language") == lang, F.lit(min(1.0, 1.2 * per_language / n))).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) / 1e6

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"language": df["language"], "h": df["h"], "own": [drawn_sentences(t, int(h)) for t, h in zip(df["text"], df["h"])]})

    drawn = labelled.where(spread < share).select("language", F.xxhash64("doc_id", F.lit(SEED)).alias("h"), "text").mapInPandas(run, "language string, h bigint, own array<string>")
    rows = drawn.limit(len(LANGUAGES) * per_language * 2).collect()
    out, taken = [], dict.fromkeys(LANGUAGES, 0)
    for r in sorted(rows, key=lambda r: (r["h"], r["own"])):
        if taken[r["language"]] < per_language:
            taken[r["language"]] += 1
            out.append((r["own"], r["language"]))
    return out


def fit_on(docs: DataFrame, per_language: int = TRAIN_DOCS) -> ByteCnn:
    return train(draw_samples(docs, per_language))


def classify(model: ByteCnn, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log probabilities of each unit, mean probabilities of each unit)."""
    return Reader(model).read([tokens(u) for u in units])[:2]


def best_path(scores: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The language of each sentence: most probable path, where a change costs so much."""
    n, k = scores.shape
    back = np.zeros((n, k), dtype=np.int64)
    at = scores[0].copy()
    for i in range(1, n):
        top = int(at.argmax())
        moved = at[top] - change
        stay = at >= moved
        back[i] = np.where(stay, np.arange(k), top)
        at = np.where(stay, at, moved) + scores[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(at.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def runs(path: np.ndarray, scores: np.ndarray, least: int = 2) -> list[tuple[int, int, int]]:
    """(first, end, language) of maximal runs; the weakest run of under least sentences joins a neighbour until none is left."""
    path = path.copy()
    while True:
        cuts = np.flatnonzero(np.diff(path)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(path)]
        short = [i for i in range(len(starts)) if ends[i] - starts[i] < least]
        if len(starts) == 1 or not short:
            return [(int(a), int(b), int(path[a])) for a, b in zip(starts, ends)]
        i = min(short, key=lambda i: (ends[i] - starts[i], starts[i]))
        sides = [path[starts[j]] for j in (i - 1, i + 1) if 0 <= j < len(starts)]
        path[starts[i] : ends[i]] = max(sides, key=lambda s: scores[starts[i] : ends[i], s].sum())


def one_language(scores: np.ndarray, change: float = CHANGE) -> int | None:
    """The language of a best path without a change, or null if one with changes may be better: a change costs more than all
    sentences together gain by their own best languages."""
    sums = scores.sum(axis=0)
    top = int(sums.argmax())
    return top if scores.max(axis=1).sum() - sums[top] <= change else None


def segments(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, segment_no, language, confidence, n_sentences, label): every text with words; segment_no is 0 for a text in
    one language, else counts from 1. label is the language that the document's label names."""
    slim = spread(docs.where("doc_id is not null and text is not null").select(docs["doc_id"].cast("bigint"), docs["lang"].cast("string"), docs["text"].cast("string")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for df in frames:
            for at in range(0, len(df), 256):
                part = df.iloc[at : at + 256]
                units, spans = [], []
                for text in part["text"]:
                    own = pieces(text)
                    spans.append((len(units), len(units) + len(own)))
                    units += [ws for _, ws in own]
                total, mean, _ = reader.read(units)
                rows = []
                for doc_id, lang, (a, b) in zip(part["doc_id"], part["lang"], spans):
                    if a == b:
                        continue
                    only = one_language(total[a:b])
                    found = [(0, b - a, only)] if only is not None else runs(best_path(total[a:b]), total[a:b])
                    label = label_language(lang)
                    for no, (x, y, k) in enumerate(found):
                        rows.append((doc_id, no + 1 if len(found) > 1 else 0, LANGUAGES[k], float(mean[a + x : a + y, k].mean()), y - x, label))
                yield pd.DataFrame(rows, columns=["doc_id", "segment_no", "language", "confidence", "n_sentences", "label"])

    return slim.mapInPandas(run, "doc_id bigint, segment_no int, language string, confidence double, n_sentences int, label string")


def found(docs: DataFrame, model: ByteCnn | None = None) -> DataFrame:
    """(doc_id, segment_no, language): texts in one language whose label is missing or wrong, and all segments of mixed texts."""
    every = segments(docs, model or fit_on(docs))
    return every.where("segment_no > 0 or label is null or label <> language").select("doc_id", "segment_no", "language")


def report(docs: DataFrame, model: ByteCnn | None = None) -> DataFrame:
    """Documents by label, language found and whether they are mixed, with the mean confidence."""
    every = segments(docs, model or fit_on(docs))
    return every.groupBy("label", "language", (F.col("segment_no") > 0).alias("mixed")).agg(F.countDistinct("doc_id").alias("docs"), F.avg("confidence").alias("confidence"))
