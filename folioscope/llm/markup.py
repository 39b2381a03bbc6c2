"""Markup residue in text documents.

Three steps. (1) Every text's containers (tags, fences, lists, environments ...) are found and
scored by the evidence at hand (closed, words inside, neighbours of the same sort, beginning of a
line or paragraph); a container is named by a generalised path: the family's construct with its tag
and class path, plus the kind of place it stands in, never by its score. (2) The paths are put to the
vote per host in Spark, smoothed by all hosts. (3) The texts are extracted again under the winning
paths of their host: a container counts if its path won, however weak its own score, so that
``+ x`` at the start of a wrapped formula line and a list item without words fall apart.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.session import materialize

FAMILIES = ("html", "markdown", "wiki", "latex")

#: Texts without any of these can't hold a container (tested inside the JVM): one alternative at least for every pattern
#: below, never narrower than it. Java's ``\w``, ``\s`` and ``\d`` are ASCII only, hence ``\p{Nd}``.
CANDIDATE = (
    r"<[A-Za-z/!]|&#|&[A-Za-z][A-Za-z0-9]{1,31};|`|~~|(?m)^ {0,3}#{1,6}\s|(?m)^ {0,3}(=+|-{2,})\s*$|(?m)^\s*([-+*]|\p{Nd}{1,3}[.)])\s+\S|(?m)^ {0,3}>"
    r"|\*\*|__|\]\(|\[\[|\{\{|(?m)^\s*\{\||''|\\[A-Za-z(\[\\]|\$|(?m)^={2,}|(?<!\S)[*_]\S|\[https?:"
    r"|(?m)^[ \t]*(?:\|[ \t]*:?-{3,}|:?-{3,}:?[ \t]*\|)|(?<![\w*\\])\*(?=[^\s*])[^*\n]+\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]+_(?![\w_])"
)

# Element names of HTML that documents use.
_TAGS = frozenset(
    "a abbr address article aside b big blockquote body br caption center cite code col dd del details dfn div dl dt em figcaption figure font footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li link main mark math meta nav ol p pre q s samp script section select small span "
    "strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var".split()
)
_VOID = frozenset("br hr img input link meta col".split())
_WIKI_TAGS = frozenset("ref nowiki references gallery syntaxhighlight".split())

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)(/?)>")
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>", re.S | re.I)
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^ {0,3}\1[ \t]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<pre\b[^>]*>(.*?)</pre>", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", re.S)
_TICK = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*)$", re.M)
_SETEXT = re.compile(r"^(?=[^\n]*\w)([^\n|]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_ITEM = re.compile(r"^([ \t]*)([-+*]|\d{1,3}[.)])[ \t]+(\[[ xX]\] )?(\S[^\n]*)$", re.M)
_QUOTE = re.compile(r"^ {0,3}>[ \t]?([^\n]*)$", re.M)
_PIPES = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", re.M)
_BOLD = re.compile(r"(?<![\w*])\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*(?!\*)|(?<![\w_])__(?=\S)((?:(?!__)[^\n])+?)(?<=\S)__(?![\w_])")
_EMPH = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+)(?<=\S)~~")
_IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
_LINK = re.compile(r"(?<!!)\[([^\]\n]+)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_WIKI_URL = re.compile(r"(?<!\[)\[https?://\S+( [^\]\n]+)?\](?!\()")
_TEMPLATE = re.compile(r"\{\{(?=[A-Za-z#])([^{}]+)\}\}")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)(?:^[ \t]*\|\}[ \t]*$|\Z)", re.S | re.M)
_WIKI_BOLD = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])([^'\n]+?)\1(?!')")
_WIKI_WORD = re.compile(r"__(?:NO)?TOC__|__NOEDITSECTION__")
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
_DISPLAY = re.compile(r"\\\[(.+?)\\\]|\$\$(.+?)\$\$", re.S)
_INLINE = re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])([^$\n]+?)(?<=[^\s\\$])\$(?![\d$])", re.S)
_COMMAND = re.compile(r"\\([A-Za-z]+\*?|\\)")
_GROUP = re.compile(r"\{\\(?:it|bf|em|sc|tt|rm|sl)\s+([^{}]*)\}")

# Environments whose body is a formula, and commands that only wrap their argument.
_FORMULA_ENVS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math")


def _words(text: str) -> float:
    """Share of the pieces between blanks that are words of two letters or more."""
    pieces = text.split()
    return sum(bool(re.fullmatch(r"[^\W\d_]{2,}[.,;:!?]?", p)) for p in pieces) / len(pieces) if pieces else 0.0


def _mask(text: str, pattern: re.Pattern) -> str:
    """The same text with the matches blanked out, places kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", "\x00", m.group(0)), text)


def _line_before(text: str, at: int) -> str:
    end = text.rfind("\n", 0, at)
    return "" if end < 0 else text[text.rfind("\n", 0, end) + 1 : end]


def _located(text: str) -> list[tuple[str, str, float, list[tuple[int, int]]]]:
    """(family, path, score from 0 to 1, marks) of each container of ``text``.

    The score says how much the container looks like markup where it stands: known element or
    command, closed, words inside, neighbours of the same sort. Its marks are the spans of ``text``
    that make it a container: all of it, or what stands around or before its running text.
    """
    out: list[tuple[str, str, float, list[tuple[int, int]]]] = []

    def add(m: re.Match, family: str, path: str, score: float, *marks: tuple[int, int]) -> None:
        out.append((family, f"{family}:{path}", score, list(marks) or [m.span()]))

    def around(m: re.Match) -> list[tuple[int, int]]:
        """The marks before and behind the group that matched."""
        start, end = m.span(m.lastindex)
        return [(m.start(), start), (end, m.end())]

    for m in _COMMENT.finditer(text):
        add(m, "html", "comment", 1.0)
    rest = _mask(text, _COMMENT)
    for m in _FENCE.finditer(rest):
        add(m, "markdown", "fence", 1.0)
    rest = _mask(rest, _FENCE)
    for m in _PRE.finditer(rest):
        add(m, "html", "pre/code" if "<code" in m.group(0).lower() else "pre", 1.0)
    rest = _mask(rest, _PRE)
    for m in _VERBATIM.finditer(rest):
        add(m, "latex", f"env.{m.group(1)}", 1.0)
    rest = _mask(rest, _VERBATIM)
    for m in _TICK.finditer(rest):
        add(m, "markdown", "code", 1.0)
    rest = _mask(rest, _TICK)

    stack: list[str] = []
    tags = list(_TAG.finditer(rest))
    opened = Counter(m.group(2).lower() for m in tags if not m.group(1))
    closed = Counter(m.group(2).lower() for m in tags if m.group(1))
    for m in tags:
        closing, name, attrs, void = m.group(1), m.group(2).lower(), m.group(3), m.group(4)
        family = "wiki" if name in _WIKI_TAGS else "html"
        known = name in _TAGS or family == "wiki"
        step = name + ("." + re.split(r"\W", attrs.strip().lower())[0] if attrs.strip() else "")
        if closing:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at].partition(".")[0] == name:
                    del stack[at:]
                    break
        paired = void or name in _VOID or opened[name] == closed[name]
        add(m, family, "/".join([*stack[-3:], step]) if known else "unknown", (0.65 if known else 0.05) + 0.3 * bool(paired) + 0.05 * bool(attrs.strip() or void))
        if not (closing or void or name in _VOID) and known:
            stack.append(step)
    rest = _mask(rest, _TAG)
    for m in _ENTITY.finditer(rest):
        body = m.group(1)
        known = body[0] == "#" or body + ";" in html.entities.html5
        add(m, "html", "entity" if known else "entity.unknown", 1.0 if known else 0.1)

    for m in _DISPLAY.finditer(rest):
        add(m, "latex", "display", 1.0)
    math_free = _mask(rest, _DISPLAY)
    for m in _INLINE.finditer(math_free):
        body = m.group(1) or m.group(2)
        # Two sums of money with words between look like a formula: what follows a dollar sign with a digit has its own vote.
        sum_ = m.group(2) is not None and re.match(r"\d", body)
        add(m, "latex", "inline.digit" if sum_ else "inline", (0.8 if sum_ else 1.0) - 0.7 * min(1.0, 2 * _words(body)) * bool(sum_ or not re.search(r"[\\^_=<>{}]", body)), *(around(m) if sum_ else []))
    math_free = _mask(math_free, _INLINE)
    for m in _ENV.finditer(math_free):
        add(m, "latex", f"env.{m.group(2)}", 1.0)
    for m in _COMMAND.finditer(_mask(math_free, _ENV)):
        add(m, "latex", "command", 1.0)
    math_free = _mask(math_free, _COMMAND)

    for m in _WIKI_TABLE.finditer(math_free):
        add(m, "wiki", "table", 1.0)
    flat = _mask(math_free, _WIKI_TABLE)
    for m in _WIKI_HEAD.finditer(flat):
        add(m, "wiki", "heading", 1.0, *around(m))
    for m in _WIKI_LINK.finditer(flat):
        add(m, "wiki", "link", 1.0 if re.search(r"[^\W\d]{2,}", m.group(1)) else 0.4)
    for m in _WIKI_URL.finditer(flat):
        add(m, "wiki", "url", 1.0)
    for m in _TEMPLATE.finditer(flat):
        add(m, "wiki", "template", 1.0)
    for m in _WIKI_BOLD.finditer(flat):
        add(m, "wiki", "bold", 1.0, *around(m))
    for m in _WIKI_WORD.finditer(flat):
        add(m, "wiki", "magic", 1.0)
    flat = _mask(_mask(flat, _WIKI_LINK), _WIKI_WORD)

    for m in _ATX.finditer(flat):
        add(m, "markdown", "heading", 0.3 + 0.7 * min(1.0, 2 * _words(m.group(2))), (m.start(), m.start(2)))
    for m in _SETEXT.finditer(flat):
        add(m, "markdown", "setext", 0.4 + 0.6 * min(1.0, 2 * _words(m.group(1))), m.span(2))
    items = list(_ITEM.finditer(flat))
    starts = {m.start() for m in items}
    for m in items:
        before, mark = _line_before(flat, m.start()), m.group(2)
        fresh = m.start() == 0 or not before.strip() or before.rstrip().endswith(":")
        run = (m.end() + 1) in starts or any(x.end() + 1 == m.start() for x in items)
        number = mark[:-1].isdigit()
        place = ("fresh" if fresh else "run" if run else "loose") + (".task" if m.group(3) else "")
        worded = min(1.0, 2 * _words(m.group(4)))
        odd = number and not run and mark[:-1] != "1"
        score = 0.1 + 0.5 * worded + 0.25 * fresh + 0.25 * run + 0.15 * bool(m.group(3)) - 0.3 * (mark in "+*" and not worded) - 0.4 * odd
        add(m, "markdown", f"item.{'n' if number else mark}.{place}", max(0.0, min(1.0, score if fresh or run else 0.4 * worded)), (m.start(), m.start(4)))
    quotes = list(_QUOTE.finditer(flat))
    for m in quotes:
        before = _line_before(flat, m.start())
        fresh = m.start() == 0 or not before.strip() or before.lstrip().startswith(">") or before.lstrip("\x00 \t") == "" or before.rstrip().endswith((".", ":", "}", "]", ">", "|", "∎"))
        worded = min(1.0, 2 * _words(m.group(1)))
        add(m, "markdown", "quote" if fresh else "quote.loose", 0.3 * fresh + 0.7 * worded if fresh else 0.3 * worded, (m.start(), m.start(1)))
    for m in _PIPES.finditer(flat):
        if "|" in m.group(0):
            add(m, "markdown", "table", 1.0 if "|" in _line_before(flat, m.start()) else 0.3)
    for pattern, path in ((_IMAGE, "image"), (_LINK, "link"), (_STRIKE, "strike"), (_BOLD, "bold")):
        for m in pattern.finditer(flat):
            add(m, "markdown", path, 1.0, *around(m))
    for m in _EMPH.finditer(_mask(flat, _BOLD)):
        inner = m.group(1) or m.group(2)
        worded = re.search(r"[^\W\d_]{2,}", inner) is not None
        add(m, "markdown", "emphasis" if worded else "emphasis.symbol", 0.2 + 0.7 * min(1.0, 2 * _words(inner)), *around(m))
    return out


def containers(text: str) -> list[tuple[str, str, float]]:
    """(family, path, score from 0 to 1) of each container of ``text``."""
    return [found[:3] for found in _located(text)]


def _score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, uid, text in zip(batch["host"], batch["id"], batch["text"]):
            seen: dict[tuple[str, str], list[float]] = {}
            for family, path, score in containers(text):
                seen.setdefault((family, path), []).append(score)
            rows += [(host, uid, family, path, sum(s) / len(s), len(s)) for (family, path), s in seen.items()]
        yield pd.DataFrame(rows, columns=["host", "id", "family", "path", "score", "pieces"])


def scored_containers(texts: DataFrame) -> DataFrame:
    """(host, id, family, path, score, pieces), one row per text and path, from (host, id, text).

    NULL, empty and plain texts give no rows.
    """
    likely = texts.where(F.col("text").rlike(CANDIDATE))
    return likely.select("host", "id", "text").mapInPandas(_score_batches, "host string, id bigint, family string, path string, score double, pieces int")


def path_votes(scored: DataFrame, weight: float = 3.0, quorum: float = 0.5) -> DataFrame:
    """(host, path, texts, support, wins): each host's verdict on each path it uses.

    Every text of a host casts its mean score; ``weight`` texts of the mean over all hosts are
    added, so hosts with few texts follow the consensus. Both sums are combined before the shuffle,
    so a host with a third of the texts is no burden.
    """
    local = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("texts"), F.sum("score").alias("points"))
    overall = local.groupBy("path").agg((F.sum("points") / F.sum("texts")).alias("mean"))
    support = (F.col("points") + weight * F.col("mean")) / (F.col("texts") + weight)
    return local.join(overall, "path").select("host", "path", "texts", support.alias("support"), (support >= quorum).alias("wins"))


def markup_families(texts: DataFrame, votes: bool = True) -> DataFrame:
    """(id, family): the families of which a text holds at least one container on a winning path.

    ``votes`` = False lets every text's own score decide, for comparison.
    """
    scored = materialize(scored_containers(texts))
    if not votes:
        return scored.where("score >= 0.5").select("id", "family").distinct()
    won = path_votes(scored).where("wins").groupBy(F.col("host").alias("h")).agg(F.collect_set("path").alias("won"))
    return scored.join(won, F.col("host").eqNullSafe(F.col("h"))).where(F.array_contains("won", F.col("path"))).select("id", "family").distinct()


def _tex_to_text(text: str) -> str:
    for env in _FORMULA_ENVS:
        text = re.sub(rf"\\begin\{{{env}\*?\}}\s*(.*?)\s*\\end\{{{env}\*?\}}", lambda m: f"\n$ {m.group(1)} $\n", text, flags=re.S)
    text = _DISPLAY.sub(lambda m: f"$ {(m.group(1) or m.group(2)).strip()} $", text)
    text = re.sub(r"\\\((.+?)\\\)", r"$\1$", text, flags=re.S)
    formulas = re.split(r"(\$[^$]+\$)", text)
    for i in range(0, len(formulas), 2):
        part = formulas[i]
        part = re.sub(r"\\(?:sub)*(?:section|paragraph|chapter)\*?\{([^{}]*)\}", r"\n# \1\n", part)
        part = re.sub(r"\\label\{[^{}]*\}\s?", "", part)
        part = re.sub(r"~?\\(?:eq)?ref\{([^{}]*)\}", r" [\1]", part)
        part = re.sub(r"\\item\s*", "\n- ", part)
        part = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}", "\n", part)
        part = _GROUP.sub(r"\1", part)
        unwrapped = None
        while unwrapped != part:
            unwrapped, part = part, re.sub(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", part)
        part = re.sub(r"((?:\\[A-Za-z]+\s*)+)", lambda m: f"${m.group(1).strip()}$ ", part)
        formulas[i] = part.replace("\\\\", "\n")
    return "".join(formulas)


def _pipe_tables(text: str) -> str:
    """``text`` without the rules of its pipe tables and the outer bars of their rows; other lines between bars stay."""
    lines = text.split("\n")
    rules = [i for i, line in enumerate(lines) if "|" in line and _PIPES.match(line)]
    rows: set[int] = set()
    for i in rules:
        if i and "|" in lines[i - 1]:
            rows.add(i - 1)
        while i + 1 < len(lines) and "|" in lines[i + 1]:
            i += 1
            rows.add(i)
    drop = frozenset(rules)
    return "\n".join(re.sub(r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", line) if i in rows else line for i, line in enumerate(lines) if i not in drop)


def clean_text(text: str | None, lost: frozenset[str] = frozenset()) -> str | None:
    """``text`` without markup; the structure stays in one plain notation.

    Headings become ``# title`` lines, list items ``- item``, code blocks are fenced, short code is
    back-quoted, formulas stand between dollar signs, table cells between `` | ``. Containers on a
    path in ``lost`` are left as they are, and so is plain mathematics. NULL stays NULL.
    """
    if text is None:
        return None
    kept: list[str] = []

    def keep(block: str) -> str:
        kept.append(block)
        return f"\x01{len(kept) - 1}\x02"

    # The marks on lost paths are taken out of sight first, so none of the steps below sees them.
    pieces, at = [], 0
    for start, end in sorted(span for _, path, _, marks in (_located(text) if lost else ()) if path in lost for span in marks):
        if end > max(start, at):
            start = max(start, at)
            pieces += [text[at:start], keep(text[start:end])]
            at = end
    text = "".join(pieces) + text[at:]
    text = _COMMENT.sub("", text)
    text = _FENCE.sub(lambda m: keep("```\n" + m.group(2).rstrip("\n") + "\n```"), text)
    text = _PRE.sub(lambda m: "\n" + keep("```\n" + html.unescape(_TAG.sub("", m.group(1))).strip("\n") + "\n```") + "\n", text)
    text = _VERBATIM.sub(lambda m: keep("```\n" + m.group(2).strip("\n") + "\n```"), text)
    text = _TICK.sub(lambda m: keep("`" + m.group(1) + "`"), text)
    if re.search(r"\\[A-Za-z(\[\\]|\$", text):
        text = _tex_to_text(text)
        text = re.sub(r"\$[^$]+\$", lambda m: keep(m.group(0)), text)
    if "<" in text:
        text = re.sub(r"<code\b[^>]*>(.*?)</code>", lambda m: keep("`" + html.unescape(m.group(1)) + "`"), text, flags=re.S | re.I)
        text = re.sub(r"<h[1-6]\b[^>]*>\s*(.*?)\s*</h[1-6]>", r"\n# \1\n", text, flags=re.S | re.I)
        text = re.sub(r"<li\b[^>]*>\s*", "\n- ", text, flags=re.I)
        text = re.sub(r"<sub\b[^>]*>(.*?)</sub>", r"_\1", text, flags=re.S | re.I)
        text = re.sub(r"<sup\b[^>]*>(.*?)</sup>", r"^\1", text, flags=re.S | re.I)
        text = re.sub(r"</t[dh]>\s*<t[dh]\b[^>]*>", " | ", text, flags=re.I)
        text = re.sub(r"<(?:br|hr)\b[^>]*>|</?(?:p|div|ul|ol|table|tr|blockquote|section)\b[^>]*>", "\n", text, flags=re.I)
        text = _TAG.sub(lambda m: "" if m.group(2).lower() in _TAGS | _WIKI_TAGS else m.group(0), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group(0)), text).replace("\xa0", " ")
    if "{|" in text:
        rows = lambda m: "\n".join(re.sub(r"\s*(?:\|\||!!)\s*", " | ", r.lstrip("|! ")) for r in m.group(1).split("\n") if r.strip(" |-"))
        text = _WIKI_TABLE.sub(rows, text)
    text = _WIKI_HEAD.sub(r"# \2", text)
    text = re.sub(r"\[\[(?:File|Image|Category):[^\[\]]*\]\]\s?", "", text)
    text = _WIKI_LINK.sub(lambda m: m.group(1).rpartition("|")[2], text)
    text = _WIKI_URL.sub(lambda m: (m.group(1) or "").strip(), text)
    text = _WIKI_WORD.sub("", _TEMPLATE.sub("", text))
    text = _WIKI_BOLD.sub(r"\2", text)
    text = _ATX.sub(r"# \2", text)
    text = _SETEXT.sub(r"# \1", text)
    text = _pipe_tables(text)
    text = _LINK.sub(r"\1", _IMAGE.sub(r"\1", text))
    text = _STRIKE.sub(r"\1", _BOLD.sub(lambda m: m.group(1) or m.group(2), text))
    text = _EMPH.sub(lambda m: m.group(1) or m.group(2), text)
    text = _QUOTE.sub(r"\1", text)
    text = _ITEM.sub(lambda m: f"{m.group(1)}{m.group(2) if m.group(2)[0].isdigit() else '-'} {m.group(4)}", text)
    for i in range(len(kept) - 1, -1, -1):
        text = text.replace(f"\x01{i}\x02", kept[i])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()


@F.pandas_udf(StringType())
def _clean(texts: pd.Series, lost: pd.Series) -> pd.Series:
    return pd.Series([clean_text(t, frozenset(x if x is not None else ())) for t, x in zip(texts, lost)], dtype=object)


def clean_texts(texts: DataFrame) -> DataFrame:
    """(id, clean) for every row of (host, id, text): re-extraction under the host's winning paths.

    Texts that can hold no markup pass unchanged and never reach Python. What a host lost is a short
    list (the paths are few), joined as one row per host.
    """
    scored = materialize(scored_containers(texts))
    lost = path_votes(scored).where("NOT wins").groupBy(F.col("host").alias("h")).agg(F.sort_array(F.collect_set("path")).alias("lost"))
    maybe: Column = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    plain = texts.where(~maybe).select("id", F.col("text").alias("clean"))
    marked = texts.where(maybe).join(lost, F.col("host").eqNullSafe(F.col("h")), "left").select("id", _clean("text", "lost").alias("clean"))
    return plain.unionByName(marked)
