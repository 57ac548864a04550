"""Secret scans over a trigram inverted index, with built-in functions only.

Each rule is a regular expression. From its parse tree comes a Boolean query over trigrams: an OR of clauses,
each an AND of the trigrams of one literal that a match must hold. Postings (trigram, document) are made for
the trigrams of these queries alone; a clause is met where all its trigrams post the document, and a rule's
candidates are the documents that meet any clause. Only candidates are matched against the rule. A rule
without a mandatory trigram (such as a run of hex digits) is matched against every text.

Matches become spans without a position function: split() gives the pieces between matches and
regexp_extract_all() the matches, so running lengths give the code-point offsets.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, saved

#: Most candidate documents (some 60 bytes each) that are broadcast.
BROADCAST = 200_000


@dataclass(frozen=True)
class Rule:
    """kind; pattern; a match counts if group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in their order, then those that the method adds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)


def pem_key(ahead: bool = True) -> str:
    """A private key: from BEGIN through headers and the base64 body to the END line, or to the last base64 line where END is missing.

    Lines can be indented, quoted, marked as in a patch or a comment, or ended by an escaped \n, as in JSON; a header's
    value and the number of lines have no bound. Without body or END the BEGIN line alone is the match. Repeats are
    possessive, so that the matcher loops over lines and needs no stack for them. ahead: false for an engine that has
    neither possessive repeats nor lookahead; there each line's end must be preceded by \x01, and the text ended by it.
    """
    some = "*+" if ahead else "*"
    more, maybe = ("++", "?+") if ahead else ("+", "?")
    eol = r"(?:\r?\n|\\r\\n|\\n|\r)" if ahead else r"(?:\x01?(?:\r?\n|\\r\\n|\\n|\r))"
    lead = rf"(?:[\x20\t>#*|\"',]|[/+-]+[\x20\t]){some}"
    tail = r"(?:[\x20\t\"',;+]|\\(?![rn]))*+" if ahead else r"[\x20\t\"',;+\\]*"
    label = r"(?:(?!PRIVATE KEY)[A-Z0-9 ])*+PRIVATE KEY(?: BLOCK)?-----" if ahead else r"[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
    value = rf"(?:[^\r\n\\{'' if ahead else '\\x01'}]|\\[^rn\r\n{'' if ahead else '\\x01'}]){some}"
    header = rf"{tail}{eol}{lead}(?:[A-Za-z][A-Za-z0-9-]{some}:[\x20\t]{value}{'' if ahead else '\\\\?\\x01'})?"
    run, short = r"[A-Za-z0-9+/]{16,}={0,2}", r"(?:[A-Za-z0-9+/]{1,15}={0,2}|={1,2}[A-Za-z0-9+/]{4})"
    end = rf"(?:{tail}{eol}){some}{tail}{lead}-?-----END {label}"
    if ahead:
        body = rf"{tail}{eol}?{lead}-?(?:{run}|{short}(?={tail}(?:{eol}|-----END|$)))"
    else:
        body = rf"{tail}{eol}?{lead}-?(?:{run}|{short}{tail}\x01)"
        end = rf"(?:{tail}{eol}?{lead}-?{short})?{end}"
    return rf"-----BEGIN {label}(?:(?:{header}){some}(?:(?:{body}){more}(?:{end}){maybe}|(?:{tail}{eol})?{lead}-?-----END {label})){maybe}"


PEM_KEY = pem_key()
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", PEM_KEY),
)


def mandatory(pattern: str, most: int = 64) -> list[set[str]] | None:
    """The Boolean query of a pattern, in lower case: a list of clauses, each a set of trigrams. None: scan fully.

    Walks the parse tree for the alternatives of literal text that every match holds one of; where they grow
    beyond `most`, or a part can be absent, the literal is cut there.
    """

    def walk(tree) -> list[list[str]]:
        """Alternatives, each a list of literal pieces; '\\0' stands where other text can be."""
        outs = [""]
        for op, arg in tree:
            if op is C.LITERAL:
                more = [chr(arg)]
            elif op is C.SUBPATTERN:
                more = walk(arg[-1])
            elif op is C.BRANCH:
                more = [y for x in arg[1] for y in walk(x)]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is C.LITERAL:
                more = ["", chr(arg[2][0][1])]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                more = [x + "\0" for x in walk(arg[2])]
            elif op is C.IN and len(arg) <= 8 and all(x is C.LITERAL for x, _ in arg):
                more = [chr(x) for _, x in arg]
            else:
                more = ["\0"]
            outs = [a + b for a in outs for b in more] if len(outs) * len(more) <= most else [a + "\0" for a in outs]
        return outs

    clauses = []
    for literal in walk(P.parse(pattern)):
        grams = {piece[i : i + 3] for piece in literal.lower().split("\0") for i in range(len(piece) - 2)}
        if not grams:
            return None
        clauses.append(grams)
    least = [c for c in clauses if not any(d < c for d in clauses)]
    return [c for i, c in enumerate(least) if c not in least[:i]]


def postings(docs: DataFrame, rules) -> DataFrame:
    """key, trigram: where each trigram of the rules' queries stands in the lower-cased text."""
    grams = sorted({g for r in rules for c in mandatory(r.pattern) or [] for g in c})
    low = docs.select("key", F.lower("text").alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules) -> DataFrame:
    """key, rules: an array of the positions of the rules whose query the document meets (no row where none)."""
    clauses = [(i, k, g, len(c)) for i, r in enumerate(rules) for k, c in enumerate(mandatory(r.pattern) or []) for g in sorted(c)]
    query = docs.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, need int")  # a row a trigram of the rules: fixed size
    met = postings(docs, rules).join(F.broadcast(query), "trigram").groupBy("key", "rule", "clause").agg(F.count_distinct("trigram").alias("n"), F.max("need").alias("need")).where("n = need")
    return met.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _spans(text, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of the leftmost, non-overlapping matches that count."""
    hits, pieces = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    rows = F.arrays_zip(pieces.alias("p"), hits.alias("h"), held.alias("g"))
    sizes = F.transform(rows, lambda x: F.struct(F.length(x["p"]).alias("p"), F.coalesce(F.length(x["h"]), F.lit(0)).alias("h"), F.coalesce(F.length(x["g"]), F.lit(0)).alias("g")))

    def spans(sizes):
        starts = prefix_sums(F.transform(sizes, lambda x: (x["p"] + x["h"]).cast("bigint")))

        def span(x, at):
            start = at.cast("int") + x["p"]
            found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["h"]).alias("end"))
            return F.when(x["g"] >= rule.least, found)

        return F.filter(F.zip_with(sizes, starts, span), lambda x: x.isNotNull())

    # the lambda's variable holds the sizes, so that the text is matched once
    return F.element_at(F.transform(F.array(sizes), spans), 1)


def _scan_pattern(rule: Rule) -> Rule:
    """A single class repeated, with a least length, matches the same when the length stands in the pattern."""
    if rule.group == 0 and rule.pattern.endswith("+") and rule.least > 1 and len(P.parse(rule.pattern)) == 1:
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, 1)
    return rule


def find_secrets(docs: DataFrame, rules=BASE + ADDED) -> DataFrame:
    """docs: doc_id, text (other columns stay, but one named spans is replaced). Adds spans: array of struct(start, rank, kind, end), in order.

    Whole texts are scanned; offsets are code points, end exclusive. Null or empty text: no spans. Rows that
    repeat, also with the same doc_id, are scanned each: the index is by doc_id and a hash of the text. Spans of two
    rules may overlap; those with one start go by rule. Empty table: no rows.
    The candidates that the index names are broadcast if they are counted to be at most BROADCAST, so that texts stay
    where they are; more of them are joined by key.
    """
    kept = [c for c in docs.columns if c != "spans"]
    key = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.select(key.alias("key"), "text", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    index = saved(candidates(keyed.select("key", "text"), rules))
    joined = keyed.join(F.broadcast(index) if index.count() <= BROADCAST else index, "key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        found = _spans(F.col("text"), _scan_pattern(rule), i)
        if mandatory(rule.pattern):
            test = F.array_contains("rules", i)
        else:
            test = F.rlike("text", F.lit(_scan_pattern(rule).pattern))
        parts.append(F.when(test, found).otherwise(none))
    return joined.select("row.*", F.array_sort(F.concat(*parts)).alias("spans"))


def as_text(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text, spans, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans get one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
