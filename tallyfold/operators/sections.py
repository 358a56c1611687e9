"""Filing text: item sections, search, comparison, highlights and excerpts.

A filing's text stays in its row from scan to result; nothing is shuffled
except to bring the two texts of a comparison together. Match positions come
from the lengths of what stands between matches, so the regular expressions run
inside the engine, over the whole text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.columns import WHITE, accession_key, alnum_key, excerpt, squeeze

c = F.col

# Fixed value: an item heading at the start of a line, optionally a markdown
# heading. Groups: heading, item code, title. White space may span lines.
HEADING = r"^(?:#{1,6}\s*)?(item\s+(\d+(?:\.\d+)?[a-z]?)\.?(?:\s+([^\n]+?))?)\s*$".replace(r"\s", f"[{WHITE}]")
FLAGS = "(?imd)"
# Characters that count as white space at the ends of a text.
SPACE = (" \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085         "
         "        　")
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def strip(text: Column, chars: str = SPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it several times, inside a lambda too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pinned(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A generator is a border the optimizer does not move expressions or filters
    across, so a costly array is not rebuilt by everything that reads it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _marked_parts(text: Column, pattern: str, limit: int = -1) -> Column:
    """Text before the first match, then each match with what follows it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.split(text, pattern, limit), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(found, i - 1), p)))


# ---------------------------------------------------------------- sections


def _outlined(filings: DataFrame, text: str) -> DataFrame:
    """Add ``__parts`` (the text cut before each heading) and ``__outline``, what tells the sections apart.

    Headings are read from the matches, never again from the texts below them;
    no section's text is put together here.
    """
    pattern = FLAGS + HEADING
    whole = F.coalesce(c(text), F.lit(""))
    rows = pinned(filings, __found=F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), __tails=F.split(whole, pattern, -1))
    rows = pinned(rows, __parts=F.transform("__tails", lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get("__found", i - 1), p))))
    rows = pinned(rows, __heads=F.transform("__found", lambda h, i: F.struct(
        alnum_key(F.regexp_extract(h, pattern, 2)).alias("key"), F.length(F.get("__parts", i + 1)).alias("len"),
        _newlines(F.get("__parts", i + 1)).alias("nl"))))
    rows = pinned(rows, __keys=F.transform("__heads", lambda h: h["key"]))
    later = lambda i: F.slice("__keys", i + 2, F.greatest(F.size("__keys") - i - 1, F.lit(0)))
    rows = pinned(rows, __kept=F.filter(
        F.transform("__keys", lambda k, i: F.when(~F.array_contains(later(i), k), i)), lambda i: i.isNotNull()))

    def section(i: Column, n: Column) -> Column:
        end = F.coalesce(F.try_element_at("__kept", n + 2), F.size("__heads"))
        head = F.get("__found", i)
        code = F.upper(F.regexp_replace(F.lower(F.regexp_extract(head, pattern, 2)), "[^0-9a-z.]+", ""))
        before = F.slice("__heads", 1, i)
        return F.struct(
            (n + 1).alias("position"), squeeze(F.regexp_extract(head, pattern, 1)).alias("heading"), code.alias("item_code"),
            alnum_key(code).alias("item_key"), _title(F.regexp_extract(head, pattern, 3)).alias("title"),
            (F.length(F.element_at("__parts", 1)) + _total(F.transform(before, lambda h: h["len"]))).alias("start"),
            (_newlines(F.element_at("__parts", 1)) + _total(F.transform(before, lambda h: h["nl"])) + 1).alias("line_number"),
            i.alias("first"), (end - i).alias("parts"), F.length(head).alias("matched"),
        )

    rows = pinned(rows, __s=F.transform("__kept", section))
    full = F.transform("__s", lambda s: s.withField("title_key", alnum_key(s["title"]))
                       .withField("match_keys", F.array_distinct(F.array_compact(F.array(
                           s["item_key"], alnum_key(F.concat(F.lit("item "), s["item_code"])),
                           alnum_key(s["heading"]), alnum_key(s["title"]))))))
    return pinned(rows, __outline=full).drop("__found", "__tails", "__heads", "__keys", "__kept", "__s")


def _raw(s: Column) -> Column:
    """The text of an outlined section, heading and all."""
    return F.array_join(F.slice("__parts", s["first"] + 2, s["parts"]), "")


def with_sections(filings: DataFrame, text: str = "markdown", name: str = "sections") -> DataFrame:
    """Add the parsed item sections as an array of structs, in text order.

    When a code occurs more than once the last one counts, which skips the
    table of contents. A section ends where the next kept one starts.
    """
    rows = pinned(_outlined(filings, text), __texts=F.transform("__outline", _raw))
    plain = ["position", "heading", "item_code", "item_key", "title", "start", "line_number"]
    rows = pinned(rows, __contents=F.transform("__texts", lambda raw: strip(raw)))
    full = F.transform("__outline", lambda s, n: F.struct(
        *[s[x].alias(x) for x in plain], F.get("__contents", n).alias("content"),
        strip(F.substr(F.get("__texts", n), s["matched"] + 1)).alias("body"), s["title_key"].alias("title_key"),
        F.length(F.get("__contents", n)).alias("text_length"), s["match_keys"].alias("match_keys")))
    return pinned(rows, **{name: full}).drop("__parts", "__outline", "__texts", "__contents")


def _title(raw: Column) -> Column:
    # The characters stripped from a title, and a page number at its end.
    bare = strip(squeeze(raw), " .:-")
    bare = F.trim(F.regexp_replace(bare, r"\s+\d+$", ""))
    return F.when(bare != "", bare)


def sections(filings: DataFrame, keys: list[str] = ("accession_number",), text: str = "markdown") -> DataFrame:
    """One row per section, ready to be stored as a table of its own."""
    return with_sections(filings, text).select(*keys, F.inline("sections"))


def section_list(filings: DataFrame, keys=("accession_number",), text: str = "markdown") -> DataFrame:
    preview = excerpt(F.coalesce(F.when(c("body") != "", c("body")), c("content")), 280)
    return sections(filings, keys, text).select(
        *keys, "item_code", "heading", "title", "line_number", "text_length", preview.alias("preview"))


def selector_key(section_name: str) -> str:
    return re.sub("[^a-z0-9]+", "", section_name.strip().lower())


def _selected(s: Column, key: str) -> Column:
    hit = F.array_contains(s["match_keys"], key)
    if key == "mda":
        title = F.coalesce(s["title_key"], F.lit(""))
        hit = hit | (title.contains("management") & title.contains("discussion"))
    return hit


def _first_selected(sections_col: str, key: str) -> Column:
    return F.try_element_at(F.filter(sections_col, lambda s: _selected(s, key)), F.lit(1))


def extract_section(filings: DataFrame, section_name: str, keys=("accession_number",), text: str = "markdown") -> DataFrame:
    """The first section that a code, heading or title selects ("mda" is an alias), one row per filing that has it."""
    key = selector_key(section_name)
    found = pinned(_outlined(filings, text), __hit=_first_selected("__outline", key)).where(c("__hit").isNotNull() & F.lit(bool(key)))
    # only the section that was asked for is put together
    found = pinned(found, content=strip(_raw(c("__hit"))))
    return found.select(
        *keys, *[c(f"__hit.{f}").alias(f) for f in ("item_code", "heading", "title", "line_number")],
        F.length("content").alias("text_length"), "content")


# ---------------------------------------------------------------- search


def search(
    filings: DataFrame, query: str, section_name: str | None = None, max_matches: int | None = None, context_chars: int = 280,
    keys=("accession_number",), text: str = "markdown",
) -> DataFrame:
    """Matches of a phrase per filing, in text order, with excerpt and line number; the first ``max_matches`` if asked for.

    White space in the phrase matches any white space and case does not
    count. Parsed sections are searched, the whole text where there are none.
    """
    tokens = [re.escape(t) for t in query.strip().split()]
    key = selector_key(section_name) if section_name else None
    if not tokens or (max_matches is not None and max_matches <= 0) or key == "":
        return filings.select(*keys).where(F.lit(False))
    pattern = "(?iu)" + f"[{WHITE}]+".join(tokens)
    around = max(context_chars, 0)
    candidates = filings.where(c(text).rlike(pattern))
    source = F.transform("sections", lambda s: F.struct(
        s["content"].alias("content"), s["line_number"].alias("line_number"), s["item_code"].alias("item_code"),
        s["heading"].alias("heading"), s["title"].alias("title"), s["match_keys"].alias("match_keys"), s["title_key"].alias("title_key")))
    if key is not None:
        source = F.filter(source, lambda s: _selected(s, key))
    else:
        none = F.lit(None).cast("string")
        whole = F.array(F.struct(
            c(text).alias("content"), F.lit(1).alias("line_number"), none.alias("item_code"), none.alias("heading"),
            none.alias("title"), F.array().cast("array<string>").alias("match_keys"), none.alias("title_key")))
        source = F.when(F.size("sections") > 0, source).otherwise(whole)

    def with_parts(s: Column) -> Column:
        found = F.regexp_extract_all(s["content"], F.lit(pattern), F.lit(0))
        return F.struct(s.alias("s"), _marked_parts(s["content"], pattern, -1 if max_matches is None else max_matches + 1).alias("p"), found.alias("f"))

    def hits(x: Column) -> Column:
        content = x["s"]["content"]
        tail = F.slice(x["p"], 2, F.greatest(F.size(x["p"]) - 1, F.lit(0)))

        def hit(part: Column, i: Column) -> Column:
            before = F.array_join(F.slice(x["p"], 1, i + 1), "")
            found = F.get(x["f"], i)

            def place(start: Column, lines: Column) -> Column:
                end = start + F.length(found)
                lo = F.greatest(start - around, F.lit(0))
                hi = F.least(end + around, F.length(content))
                bare = squeeze(F.substr(content, lo + 1, hi - lo))
                shown = let(bare, lambda b: F.concat(
                    F.when((lo > 0) & (b != ""), "...").otherwise(""), b,
                    F.when((hi < F.length(content)) & (b != ""), "...").otherwise("")))
                return F.struct(
                    squeeze(found).alias("matched_text"), shown.alias("excerpt"),
                    (x["s"]["line_number"] + lines).alias("line_number"), x["s"]["item_code"].alias("item_code"),
                    x["s"]["heading"].alias("heading"), x["s"]["title"].alias("title"))

            measured = let(before, lambda b: F.struct(F.length(b).alias("at"), _newlines(b).alias("nl")))
            return let(measured, lambda m: place(m["at"], m["nl"]))

        return F.transform(tail, hit)

    rows = pinned(with_sections(candidates, text), __src=F.transform(source, with_parts))
    rows = pinned(rows, __hits=_first(F.flatten(F.transform("__src", hits)), max_matches))
    return rows.select(*keys, F.posexplode("__hits").alias("n", "h")).select(
        *keys, (c("n") + 1).alias("match_number"), F.lit(query.strip()).alias("query"), "h.*")


# ---------------------------------------------------------------- comparison


def blocks(text: Column) -> Column:
    """Paragraphs with collapsed white space, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), squeeze), lambda b: b != "")


def _numbered(items: Column) -> Column:
    """Each block with the number of equal blocks before it, so that lists compare as multisets."""
    plain = F.transform(items, lambda b: F.struct(b.alias("b"), F.lit(0).alias("k")))
    counted = F.transform(items, lambda b, i: F.struct(b.alias("b"), F.size(F.filter(F.slice(items, 1, i), lambda y: y == b)).alias("k")))
    return F.when(F.size(F.array_distinct(items)) == F.size(items), plain).otherwise(counted)


def compare_sections(pairs: DataFrame, filings: DataFrame, section_name: str, max_changes: int | None = None,
                     excerpt_chars: int | None = 280, text: str = "markdown") -> DataFrame:
    """Block changes of one section between pairs (accession_number, previous_accession).

    Blocks compare as multisets, wherever they stand: with ``m`` blocks in both
    and ``t`` in all, the similarity is ``2 m / t``, 1 without any block. The
    others are listed in the order of their text. Only filings of a pair are
    parsed.
    """
    asked = pairs.select(F.explode(F.array("accession_number", "previous_accession")).alias("accession_number")).distinct()
    found = extract_section(filings.join(asked, "accession_number", "left_semi"), section_name, ("accession_number",), text)
    cols = ["item_code", "heading", "title", "line_number", "text_length", "content"]
    now = found.select("accession_number", *[c(x).alias(f"n_{x}") for x in cols])
    old = found.select(c("accession_number").alias("previous_accession"), *[c(x).alias(f"o_{x}") for x in cols])
    both = pairs.join(now, "accession_number").join(old, "previous_accession")
    d = pinned(both, __now=_numbered(blocks(c("n_content"))), __old=_numbered(blocks(c("o_content"))))
    d = pinned(d, now_only=F.transform(F.array_except("__now", "__old"), lambda x: x["b"]), old_only=F.transform(F.array_except("__old", "__now"), lambda x: x["b"]))
    total = F.size("__now") + F.size("__old")
    similarity = F.when(total == 0, 1.0).otherwise(F.round((total - F.size("now_only") - F.size("old_only")) / total, 6))

    def few(col: str) -> Column:
        own = _first(c(col), max_changes)
        return own if excerpt_chars is None else F.transform(own, lambda b: excerpt(b, excerpt_chars))

    return d.select(
        "accession_number", "previous_accession",
        *[F.coalesce(f"n_{x}", f"o_{x}").alias(x) for x in ("item_code", "heading", "title")],
        c("n_line_number").alias("current_line_number"), c("o_line_number").alias("previous_line_number"),
        c("n_text_length").alias("current_text_length"), c("o_text_length").alias("previous_text_length"),
        similarity.alias("similarity_ratio"), F.size("now_only").alias("current_only_count"),
        F.size("old_only").alias("previous_only_count"), few("now_only").alias("current_only_excerpts"),
        few("old_only").alias("previous_only_excerpts"),
    )


# ---------------------------------------------------------------- themes and highlights

BULLET = "^[•-]"


def _lines(text: Column, both_ends: bool) -> Column:
    trimmed = F.transform(F.split(text, LINE_BREAK), lambda x: strip(x) if both_ends else F.rtrim(x))
    return F.filter(trimmed, lambda x: strip(x) != "")


def _bare(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^#+", ""))


def _lead(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), ":+$", "")


def _no_colon(line: Column) -> Column:
    return F.regexp_replace(line, ":+$", "")


def _bullet(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^[•-]+", ""))


def _headed(heading: Column, item: Column) -> Column:
    return F.when(heading.isNotNull(), F.concat(heading, F.lit(": "), item)).otherwise(item)


# Headings that open a risk section.
RISK_TITLES = ["item 1a. risk factors", "item 1a risk factors", "risk factors summary"]


def _risk_lines(text: Column) -> Column:
    """Bare lines of a risk section: titles left out, nothing from Item 1B on."""
    bare = F.filter(F.transform(_lines(text, True), _bare), lambda x: (x != "") & ~_lead(x).isin(RISK_TITLES))

    def before_1b(lines: Column) -> Column:
        stop = F.array_position(F.transform(lines, lambda x: _lead(x).startswith("item 1b")), F.lit(True))
        return F.when(stop > 0, F.slice(lines, 1, (stop - 1).cast("int"))).otherwise(lines)

    return let(bare, before_1b)


def _run(lines: Column, step) -> Column:
    """Candidates of a scan over lines that remembers the heading and whether it has one already."""
    start = F.struct(F.lit(None).cast("string").alias("heading"), F.lit(False).alias("taken"),
                     F.array().cast("array<string>").alias("out"))
    return F.aggregate(lines, start, step, lambda a: a["out"])


def _state(heading: Column, taken: Column, out: Column) -> Column:
    return F.struct(heading.alias("heading"), taken.alias("taken"), out.alias("out"))


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def risk_themes(text: Column, limit: int | None = None) -> Column:
    """"Risks related to" headings, with bullets when there are fewer than two."""
    def is_head(x):
        return _lead(x).startswith("risks related to")

    def step(a, x):
        item = _bullet(x)
        add = x.rlike(BULLET) & (item != "")
        return F.when(is_head(x), _state(_no_colon(x), a["taken"], a["out"])).when(
            add, _state(a["heading"], a["taken"], F.array_append(a["out"], _headed(a["heading"], item)))).otherwise(a)

    def themes(lines: Column) -> Column:
        heads = F.array_distinct(F.filter(
            F.transform(lines, lambda x: F.when(is_head(x), _no_colon(x))), lambda x: x.isNotNull()))
        return let(heads, lambda h: F.when(F.size(h) >= 2, h).otherwise(
            F.array_distinct(F.concat(h, _run(lines, step)))))

    return _first(let(_risk_lines(text), themes), limit)


def _first_sentence(line: Column) -> Column:
    return strip(F.split(line, r"(?<=[.!?])\s+", 2)[0])


def _short(text: Column, max_chars: int) -> Column:
    cut = lambda flat: F.concat(F.rtrim(F.substring(flat, 1, max(max_chars - 3, 1))), F.lit("..."))
    return let(squeeze(text), lambda flat: F.when(flat == "", None).when(
        F.length(flat) <= max_chars, flat).otherwise(cut(flat)))


def _highlight_step(is_head, bare, max_chars: int):
    def candidate(a, x):
        is_open = a["heading"].isNotNull() & ~a["taken"]
        item = F.when(x.rlike(BULLET), F.when(a["heading"].isNull() | is_open, _bullet(x))).when(is_open, _first_sentence(x))
        return let(item, lambda i: F.when(i != "", _short(_headed(a["heading"], i), max_chars)))

    def step(a, raw):
        return let(bare(raw), lambda x: F.when(is_head(raw), _state(_no_colon(x), F.lit(False), a["out"])).otherwise(
            let(candidate(a, x), lambda t: F.when(t.isNull(), a).otherwise(
                _state(a["heading"], a["taken"] | a["heading"].isNotNull(), F.array_append(a["out"], t))))))

    return step


# Fixed value: highlights have at most 320 characters.
def risk_highlights(text: Column, limit: int | None = None, max_chars: int = 320) -> Column:
    """First bullet or sentence under each "risks related to" heading, and bullets without a heading."""
    step = _highlight_step(lambda x: _lead(x).startswith("risks related to"), lambda x: x, max_chars)
    return _first(F.array_distinct(_run(_risk_lines(text), step)), limit)


def is_subheading(line: Column) -> Column:
    """Markdown heading, trailing colon, capitals only, or a short line of mostly capitalised words."""
    # The patterns of words and capitals, 12 words, a share of 0.8, 120 characters.
    x = _bare(line)
    words = F.regexp_extract_all(x, F.lit(r"([A-Za-z][A-Za-z'&/-]*)"), F.lit(1))
    upper = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    mostly = (F.size(words) > 0) & (F.size(words) <= 12) & (upper / F.greatest(F.size(words), F.lit(1)) >= 0.8)
    capitals = x.rlike(r"^[A-Z0-9][A-Z0-9 ,/&()'%-]{2,120}$") & x.rlike(r"\p{L}")
    short = ~((F.length(x) > 120) | x.endswith("."))
    return F.when((x == "") | x.rlike(BULLET), False).when(F.ltrim(line).startswith("#"), True).otherwise(
        short & (x.endswith(":") | capitals | mostly))


def narrative_highlights(text: Column, limit: int | None = None, max_chars: int = 320) -> Column:
    """First bullet or sentence under each narrative sub-heading."""
    lines = F.filter(_lines(text, False), lambda x: _bare(x) != "")
    return _first(F.array_distinct(_run(lines, _highlight_step(is_subheading, _bare, max_chars))), limit)


def pick_highlights(candidates: Column, limit: int = 2) -> Column:
    """Up to ``limit`` candidates, those with a new heading first."""
    def head(x):
        return F.when(x.contains(":"), F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).otherwise(x)

    def choose(cands: Column) -> Column:
        def new_heads(heads: Column) -> Column:
            return F.slice(F.filter(cands, lambda x, i: F.array_position(heads, head(x)) == i + 1), 1, limit)

        first = let(F.transform(cands, head), new_heads)
        return let(first, lambda f: F.slice(
            F.concat(f, F.filter(cands, lambda x: ~F.array_contains(f, x))), 1, limit))

    return let(candidates, choose)


def texts_by_accession(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """Full texts of the requested accessions, dashes ignored on both sides."""
    wanted = requests.select(accession_key(c("accession_number")).alias("__key")).distinct()
    return texts.join(wanted, accession_key(c("accession_number")) == c("__key"), "left_semi")


# ---------------------------------------------------------------- excerpts

# Patterns that open and close the risk and the MD&A section.
RISK_START = [r"(?im)^#+\s*item\s+1a\.?\s+risk factors\b", r"(?im)^item\s+1a\.?\s+risk factors\b", r"(?im)^item\s+1a\.?\b"]
RISK_END = [r"(?im)^#+\s*item\s+1b\.?\b", r"(?im)^#+\s*item\s+1c\.?\b", r"(?im)^#+\s*item\s+2\.?\b",
            r"(?im)^item\s+1b\.?\b", r"(?im)^item\s+1c\.?\b", r"(?im)^item\s+2\.?\b"]
_MDA = (r"item\s+7\.?\s+management'?s discussion"
        r"(?:\s+and\s+analysis(?:\s+of\s+financial\s+condition\s+and\s+results\s+of\s+operations)?)?\b")
MDA_START = [r"(?im)^#+\s*" + _MDA, r"(?im)^" + _MDA, r"(?im)^#+\s*item\s+7\.?\b", r"(?im)^item\s+7\.?\b"]
MDA_END = [r"(?im)^#+\s*item\s+7a\.?\b", r"(?im)^#+\s*item\s+8\.?\b", r"(?im)^item\s+7a\.?\b", r"(?im)^item\s+8\.?\b"]
RISK_NEEDLES = ["risk factors"]
MDA_NEEDLES = ["management's discussion", "management discussion and analysis"]


def _at(text: Column, pattern: str) -> Column:
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, at)


def section_excerpt(text: Column, starts: list[str], ends: list[str], needles: list[str]) -> Column:
    """Text from the first pattern that occurs up to the nearest end pattern.

    Without a start, the text from 800 characters before the first needle,
    and without a needle the whole text.
    """
    start = F.coalesce(*[_at(text, p) for p in starts])
    rest = F.substr(text, start + 1)
    end = F.least(*[F.coalesce(_at(rest, p), F.lit(2**31 - 2)) for p in ends])
    lowered = F.lower(text)
    needle = F.coalesce(*[F.when(F.locate(n, lowered) > 0, F.locate(n, lowered)) for n in needles])
    # Fixed value: 800 characters.
    near = F.substr(text, F.greatest(needle - 800, F.lit(1)))
    return F.when(start.isNotNull(), strip(F.substr(text, start, end))).otherwise(F.coalesce(near, text))


def risk_excerpt(text: Column) -> Column:
    return section_excerpt(text, RISK_START, RISK_END, RISK_NEEDLES)


def mda_excerpt(text: Column) -> Column:
    return section_excerpt(text, MDA_START, MDA_END, MDA_NEEDLES)


# The texts that mark what was left out.
NOTICE = "\n\n[... filing text truncated ...]"
SKIPS = [("1a", "[... skipped to Item 1A. Risk Factors ...]"),
         ("7", "[... skipped to Item 7. Management's Discussion and Analysis ...]")]


def truncated_text(filings: DataFrame, max_chars: int, head_chars: int, text: str = "markdown", name: str = "truncated") -> DataFrame:
    """Long texts cut to ``max_chars``: their head plus Item 1A, or else Item 7."""
    body = c(text)
    cut = F.concat(F.rtrim(F.substr(body, F.lit(1), F.lit(max(max_chars - len(NOTICE), 1))), F.lit(SPACE)), F.lit(NOTICE))
    if max_chars <= 0:
        return filings.withColumn(name, body)
    if max_chars <= len(NOTICE) + 256:
        return filings.withColumn(name, F.when(F.length(body) <= max_chars, body).otherwise(cut))
    head = F.rtrim(F.substr(body, F.lit(1), F.lit(min(head_chars, max_chars))), F.lit(SPACE))
    remaining = F.lit(max_chars - len(NOTICE)) - F.length(head)
    rows = with_sections(filings, text, "__sections")
    options = []
    for key, label in SKIPS:
        marker = f"\n\n{label}\n"
        found = _first_selected("__sections", key)["content"]
        budget = remaining - len(marker)
        usable = (found != "") & ~head.contains(found) & (remaining > 256) & (budget > 0)
        part = F.concat(F.lit(marker), F.rtrim(F.substr(found, F.lit(1), budget), F.lit(SPACE)))
        options.append(F.when(usable, part))
    tail = F.coalesce(*options)
    long = F.when((remaining > 256) & tail.isNotNull(),
                  F.concat(F.rtrim(F.concat(head, tail), F.lit(SPACE)), F.lit(NOTICE))).otherwise(cut)
    return rows.withColumn(name, F.when(F.length(body) <= max_chars, body).otherwise(long)).drop("__sections")
