"""Main-text extraction from HTML by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score above zero and tags below, with weights fitted on labelled
pages: pages in which exactly one ``article`` (or else ``main``) element marks the content. The contiguous run with the largest total,
found in one scan, is the content region. Tags that are usual inside articles cost next to nothing there,
tags that lie outside cost much, so the run neither breaks between paragraphs nor runs over into what surrounds them.

Elements that are never content (menus, forms, scripts, adverts, comments and so on, by element name or by
a word of their class, id or role) take no part: their words score nothing and are not printed.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 2_000  # bound on the labelled pages that the weights are fitted on
_WORD_LEAST, _TAG_LEAST, _MOST = 0.25, 0.01, 8.0
_UNSEEN_TAG, _UNSEEN_FRAME = 0.02, 0.5  # tags that no labelled page holds: those of running text, and page frames
_FRAMES = {"html", "body", "div", "section", "header", "fieldset", "center", "summary", "details", "legend", "option"}

# Element names of HTML.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot "
    "thead title tr ul".split()
)
CELLS = {"td", "th", "br"}
RAW = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp|svg|math|object|select|canvas|audio|video"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head nav aside footer form menu dialog button search".split())
# Words of class, id and role that name something other than the article.
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored sponsors promo promoted promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar sidebar side aside "
    "comment comments respond reply replies disqus discussion footer masthead topbar siteheader "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login related recommended share sharing social contentinfo complementary search widget hidden".split()
)
HEADER_WORDS = {"header", "banner", "masthead"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _is_dropped(name: str, attrs: str, in_content: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_content):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        words = set(_SPLIT.split(value))
        if key == "aria-hidden" or words & {"has", "no", "with", "without"}:
            continue  # "has-sidebar" speaks of a neighbour
        if words & DROPPED_WORDS or (not in_content and words & HEADER_WORDS):
            return True
    return False


def page_items(page: str) -> list[tuple[str, str | None, bool]]:
    """The page as (feature, text, inside): a tag with its name, or a piece of text (text not None) with the block it is in.

    Dropped elements give their own two tags and nothing between. ``inside`` tells whether the item lies
    within an ``article`` or, in pages without one, a ``main`` element.
    """
    root = "article" if re.search(r"<article[\s>]", page, re.IGNORECASE) else "main"
    items: list[tuple[str, str | None, bool]] = []
    depth, block, skip, nested, at = 0, "body", None, 0, 0
    for m in _TOKEN.finditer(page):
        if skip is None and m.start() > at:
            items.append((f"word {block}", page[at : m.start()], depth > 0))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, close = name.lower(), bool(m["close"])
        if skip is not None:
            if name in ("article", "main", "body") and not close and depth == 0:
                skip = None  # an element left open must not hide the content
            elif name == skip:
                nested += -1 if close else 1
                if nested == 0:
                    items.append((f"/dropped", None, depth > 0))
                    skip = None
                continue
            elif close and name in ("article", "main", "body") and depth > 0:
                skip = None
            else:
                continue
        if not close and name not in VOID and not m["attrs"].endswith("/") and _is_dropped(name, m["attrs"], depth > 0):
            items.append(("dropped", None, depth > 0))
            skip, nested = name, 1
            continue
        if close and name == root and depth > 0:
            depth -= 1
        feature = name if name in BLOCKS or name in CELLS else "inline"
        items.append((("/" if close else "") + feature, None, depth > 0))
        if not close and name == root:
            depth += 1
        if name in BLOCKS:
            block = name if not close else "after " + name
    if skip is None and at < len(page):
        items.append((f"word {block}", page[at:], depth > 0))
    return items


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            for feature, text, inside in page_items(page):
                counts[feature, inside] += 1 if text is None else len(text.split())
    rows = [(feature, inside, n) for (feature, inside), n in counts.items() if n]
    columns = list(zip(*rows)) if rows else [(), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64())],
        names=["feature", "inside", "n"],
    )


def fit_weights(
    pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES, key_cols: tuple[str, ...] = ("page_id", "url")
) -> dict[str, float]:
    """Log-odds of lying inside the labelled content, per feature, with one pseudo-count on each side.

    Fitted on at most ``fit_pages`` labelled pages, those with the smallest hash of their key, so reruns and
    repartitioning give the same weights. All pages are first thinned by that hash to about four times the bound, so
    that only so many meet. Features are bounded by the HTML element names.
    """
    text = F.col(html_col)
    space = 1 << 40
    chance = F.pmod(F.xxhash64(*key_cols), F.lit(space)).cast("double") * pages.count()
    keyed = pages.filter(chance < float(4 * fit_pages) * space)
    labelled = keyed.select(text.alias("html"), F.xxhash64(*key_cols).alias("place")).filter(
        (F.regexp_count(text, F.lit(r"(?i)<article[\s>]")) == 1)
        | ((F.regexp_count(text, F.lit(r"(?i)<article[\s>]")) == 0) & (F.regexp_count(text, F.lit(r"(?i)<main[\s>]")) == 1))
    )
    sample = labelled.orderBy("place", F.xxhash64("html")).limit(fit_pages).repartition(8)
    counts = sample.select("html").mapInArrow(_counted, "feature string, inside boolean, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside"),
    )
    return {r["feature"]: math.log((r["inside"] + 1) / (r["outside"] + 1)) for r in counts.collect()}


def weight_of(feature: str, weights: dict[str, float]) -> float:
    """Words at least a little above zero, tags at least a little below; unseen features by their kind."""
    if feature.startswith("word "):
        return max(_WORD_LEAST, min(_MOST, weights.get(feature, 1.0)) / _MOST)
    if feature in ("dropped", "/dropped"):
        return -_TAG_LEAST  # what surrounds the article is told by the tags that stand there
    if feature in ("article", "/article", "main", "/main"):
        return -_MOST
    usual = weights.get(feature)
    if usual is None:
        return -(_UNSEEN_FRAME if feature.lstrip("/") in _FRAMES else _UNSEEN_TAG)
    return -max(_TAG_LEAST, min(_MOST, -usual))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[low, high) of the contiguous run with the largest sum; the first and shortest of equals; (0, 0) if none is above zero."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region: blocks in page order, one line each."""
    if not page:
        return ""
    items = page_items(page)
    scores = []
    for feature, text, _ in items:
        weight = weight_of(feature, weights)
        scores.append(weight if text is None else weight * len(text.split()))
    low, high = best_region(scores)
    blocks, current = [], []
    for feature, text, _ in items[low:high]:
        if text is not None:
            current.append(text)
            continue
        name = feature.lstrip("/")
        if name in CELLS:
            current.append(" ")
        elif name in BLOCKS or name == "dropped":
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    lines = (" ".join(html_lib.unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract_main_text(
    pages: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, url, text, n_chars) of every row. Null, empty and wordless pages give the empty string.

    White space inside a block becomes one space, after character references were decoded. Other columns are
    not read. Every page is handled whole and alone, so there is no shuffle; repeated rows repeat.
    """
    fitted = fit_weights(pages, html_col, key_cols=(id_col, url_col)) if weights is None else weights

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, fitted) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    chosen = pages.select(id_col, url_col, F.col(html_col).cast("string"))
    kinds = dict(chosen.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    return chosen.mapInArrow(extracted, schema)
