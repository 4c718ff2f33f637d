"""License mentions in texts, by ordered signature rules, in column expressions only.

A rule has a label, a priority, keywords and a regular expression. Only rules of which a keyword occurs in a
text are tried on it, and only texts with one of a few gate words are looked at. Both come from the expressions:
every match holds a keyword and a gate, so they leave nothing out. Of overlapping detections, one
that lies within another of at least its priority is suppressed. Rules come from a table of licenses: each
names a license in words, and forms (tags, addresses, grants, bare names) make several rules of every entry.
"""

from __future__ import annotations

import json
from re import _constants, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.native import none, spans

# Words, separators, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

V = r"(?:,?\s+(?:version|v\.?)?\s*|[- ]v?)"  # between a name and its version
NC = r"(?:nc|non-?commercial)"
SA = r"(?:sa|share-?alike)"
ND = r"(?:nd|no-?deriv(?:ative)?s?)"
BY = r"(?:by|attribution)"
CC = r"(?:cc|creative\s+commons)[-\s]+"

#: Label, tag, name in words (a regular expression) and address.
LICENSES: list[tuple[str, str, str, str]] = [
    ("gpl-1.0", "gpl-1.0", rf"(?:gnu\s+general\s+public\s+licen[cs]e|gpl){V}1(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gpl-2.0", rf"(?:gnu\s+general\s+public\s+licen[cs]e|gnu\s+gpl|gpl){V}2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl-3.0", rf"(?:gnu\s+general\s+public\s+licen[cs]e|gnu\s+gpl|gpl){V}3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1", "lgpl-2.1", rf"(?:gnu\s+lesser\s+general\s+public\s+licen[cs]e|lgpl){V}2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl-3.0", rf"(?:gnu\s+lesser\s+general\s+public\s+licen[cs]e|lgpl){V}3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lgpl", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e|lgpl", r"gnu\.org/licenses/lgpl\.html"),
    ("agpl-3.0", "agpl-3.0", rf"(?:gnu\s+affero\s+general\s+public\s+licen[cs]e|agpl){V}3(?:\.0)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", "agpl", r"gnu\s+affero\s+general\s+public\s+licen[cs]e|agpl", r"gnu\.org/licenses/agpl\.html"),
    ("gfdl", "gfdl-1.3", r"gnu\s+free\s+documentation\s+licen[cs]e", r"gnu\.org/licenses/fdl"),
    ("apache-1.1", "apache-1.1", rf"apache\s+(?:software\s+)?licen[cs]e{V}1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache-2.0", rf"apache\s+(?:software\s+)?licen[cs]e{V}2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit", r"mit\s+licen[cs]e", r"opensource\.org/licenses/mit"),
    ("mit-0", "mit-0", r"mit\s+no\s+attribution(?:\s+licen[cs]e)?", r"github\.com/aws/mit-0"),
    ("x11", "x11", r"x11\s+licen[cs]e", r"xfree86\.org/3\.3\.6/copyright"),
    ("isc", "isc", r"isc\s+licen[cs]e", r"opensource\.org/licenses/isc"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:simplified|freebsd|2-clause|two-clause)\s+bsd\s+licen[cs]e|bsd\s+2-clause(?:\s+licen[cs]e)?", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause)\s+bsd\s+licen[cs]e|bsd\s+3-clause(?:\s+licen[cs]e)?", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:original|4-clause|four-clause)\s+bsd\s+licen[cs]e", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd-0-clause", "0bsd", r"(?:zero-clause|0-clause)\s+bsd\s+licen[cs]e", r"opensource\.org/licenses/0bsd"),
    ("bsd", "bsd-source-code", r"bsd\s+licen[cs]e", r"opensource\.org/licenses/bsd-license"),
    ("mpl-1.1", "mpl-1.1", rf"(?:mozilla\s+public\s+licen[cs]e|mpl){V}1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mpl-2.0", rf"(?:mozilla\s+public\s+licen[cs]e|mpl){V}2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "epl-1.0", rf"(?:eclipse\s+public\s+licen[cs]e|epl){V}1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl-2.0", rf"(?:eclipse\s+public\s+licen[cs]e|epl){V}2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0"),
    ("edl-1.0", "bsd-3-clause-edl", r"eclipse\s+distribution\s+licen[cs]e", r"eclipse\.org/org/documents/edl-v10"),
    ("cpl-1.0", "cpl-1.0", r"common\s+public\s+licen[cs]e", r"opensource\.org/licenses/cpl1\.0"),
    ("cddl-1.0", "cddl-1.0", r"common\s+development\s+and\s+distribution\s+licen[cs]e|cddl", r"opensource\.org/licenses/cddl-1\.0"),
    ("artistic-1.0", "artistic-1.0", rf"artistic\s+licen[cs]e{V}1(?:\.0)?", r"opensource\.org/licenses/artistic-1\.0"),
    ("artistic-2.0", "artistic-2.0", rf"artistic\s+licen[cs]e{V}2(?:\.0)?", r"opensource\.org/licenses/artistic-2\.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?\s+licen[cs]e", r"zlib\.net/zlib_license"),
    ("bsl-1.0", "bsl-1.0", r"boost\s+software\s+licen[cs]e", r"boost\.org/license_1_0"),
    ("busl-1.1", "busl-1.1", r"business\s+source\s+licen[cs]e", r"mariadb\.com/bsl11"),
    ("unlicense", "unlicense", r"the\s+unlicen[cs]e", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl|do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+licen[cs]e", r"wtfpl\.net"),
    ("openssl", "openssl", r"openssl\s+licen[cs]e", r"openssl\.org/source/license"),
    ("psf-2.0", "psf-2.0", r"python\s+software\s+foundation\s+licen[cs]e", r"docs\.python\.org/3/license"),
    ("php-3.01", "php-3.01", r"php\s+licen[cs]e", r"php\.net/license"),
    ("ruby", "ruby", r"ruby\s+licen[cs]e", r"ruby-lang\.org/en/about/license"),
    ("postgresql", "postgresql", r"postgresql\s+licen[cs]e", r"postgresql\.org/about/licence"),
    ("ncsa", "ncsa", r"university\s+of\s+illinois/ncsa\s+open\s+source\s+licen[cs]e", r"opensource\.org/licenses/ncsa"),
    ("afl-3.0", "afl-3.0", r"academic\s+free\s+licen[cs]e", r"opensource\.org/licenses/afl-3\.0"),
    ("osl-3.0", "osl-3.0", r"open\s+software\s+licen[cs]e", r"opensource\.org/licenses/osl-3\.0"),
    ("eupl-1.2", "eupl-1.2", r"european\s+union\s+public\s+licen[cs]e|eupl", r"joinup\.ec\.europa\.eu/collection/eupl"),
    ("ms-pl", "ms-pl", r"microsoft\s+public\s+licen[cs]e", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "ms-rl", r"microsoft\s+reciprocal\s+licen[cs]e", r"opensource\.org/licenses/ms-rl"),
    ("ofl-1.1", "ofl-1.1", r"(?:sil\s+)?open\s+font\s+licen[cs]e", r"scripts\.sil\.org/ofl"),
    ("vim", "vim", r"vim\s+licen[cs]e", r"vimdoc\.sourceforge\.net/htmldoc/uganda"),
    ("w3c", "w3c", r"w3c\s+software\s+(?:notice\s+and\s+)?licen[cs]e", r"w3\.org/consortium/legal"),
    ("zpl-2.1", "zpl-2.1", r"zope\s+public\s+licen[cs]e", r"opensource\.org/licenses/zpl"),
    ("upl-1.0", "upl-1.0", r"universal\s+permissive\s+licen[cs]e", r"oss\.oracle\.com/licenses/upl"),
    ("json", "json", r"json\s+licen[cs]e", r"json\.org/license"),
    ("beerware", "beerware", r"beer-?ware\s+licen[cs]e", r"spdx\.org/licenses/beerware"),
    ("odbl-1.0", "odbl-1.0", r"open\s+data(?:base)?\s+(?:commons\s+open\s+database\s+)?licen[cs]e", r"opendatacommons\.org/licenses/odbl"),
    ("sspl-1.0", "sspl-1.0", r"server\s+side\s+public\s+licen[cs]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic-2.0", r"elastic\s+licen[cs]e", r"elastic\.co/licensing/elastic-license"),
    ("cc0-1.0", "cc0-1.0", r"cc0(?:\s+1\.0)?(?:\s+universal)?", r"creativecommons\.org/publicdomain/zero"),
    ("ecl-2.0", "ecl-2.0", r"educational\s+community\s+licen[cs]e", r"opensource\.org/licenses/ecl-2\.0"),
    ("ipl-1.0", "ipl-1.0", r"ibm\s+public\s+licen[cs]e", r"opensource\.org/licenses/ipl-1\.0"),
    ("qpl-1.0", "qpl-1.0", r"q\s+public\s+licen[cs]e", r"opensource\.org/licenses/qpl-1\.0"),
    ("ssh", "ssh-short", r"openssh\s+licen[cs]e", r"openssh\.com/license"),
]


def _creative_commons() -> list[tuple[str, str, str, str]]:
    """Every kind and version of the attribution licenses, and each kind without a version."""
    kinds = {"by": BY, "by-sa": rf"{BY}[-\s]{SA}", "by-nc": rf"{BY}[-\s]{NC}", "by-nd": rf"{BY}[-\s]{ND}", "by-nc-sa": rf"{BY}[-\s]{NC}[-\s]{SA}", "by-nc-nd": rf"{BY}[-\s]{NC}[-\s]{ND}"}
    out = []
    for kind, words in kinds.items():
        for version in ("2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", r"\.")
            out.append((f"cc-{kind}-{version}", f"cc-{kind}-{version}", rf"{CC}{words}[-\s]{v}(?!\d)", rf"creativecommons\.org/licenses/{kind}/{v}"))
        out.append((f"cc-{kind}", f"cc-{kind}", rf"{CC}{words}(?![-\s](?:{SA}|{NC}|{ND}|\d))", rf"creativecommons\.org/licenses/{kind}/?(?![\d.])"))
    return out


#: Label, priority and pattern of notices that name no license.
NOTICES = [
    ("public-domain", 2, r"(?:in|into|to)\s+the\s+public\s+domain"),
    ("proprietary", 2, r"all\s+rights\s+reserved"),
    ("proprietary", 3, r"proprietary\s+and\s+confidential"),
    ("mit", 4, r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("bsd", 4, r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("isc", 4, r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software"),
    ("copyright", 1, r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d"),
    ("copyright", 1, r"©\s*(?:19|20)\d\d"),
    ("licensed", 1, r"licen[cs]ed\s+under"),
]
CONFIDENCE = {1: 0.3, 2: 0.7, 3: 0.9, 4: 0.99}
#: Words that many rules share; what they don't cover is added from the rules.
COMMON = ["licen", "copyright", "©", "spdx", "gpl", "bsd", "attribution", "creative", "reserved", "domain", "hereby", "redistribution", "permission", "wtfpl", "cddl", "eupl", "mpl", "epl", "cc0", "confidential"]
#: Like a gate for the one name that has no long word: its pattern.
CC_BY = r"cc[-\s]+by"


def _held(literals: frozenset[str], known: list[str]) -> bool:
    return all(any(word in literal for word in known) for literal in literals)


def _best(sets: list[frozenset[str]], known: list[str]) -> frozenset[str]:
    return max(sets, key=lambda s: (_held(s, known), min(map(len, s)), -len(s), sorted(s)))


def _needed(items: list, known: list[str]) -> list[frozenset[str]]:
    """Sets of literals of a parsed expression: every match holds one of each set. Known words are preferred."""
    out: list[frozenset[str]] = []
    run: list = []
    for kind, value in [*items, (None, None)]:
        if kind is _constants.LITERAL:
            run.append((kind, value))
            continue
        if run:
            out.append(frozenset(["".join(chr(c) for _, c in run)]))
        if kind is _constants.SUBPATTERN:
            out += _needed(list(value[3]), known)
        elif kind is _constants.MAX_REPEAT and value[0] > 0:
            out += _needed(list(value[2]), known)
        elif kind is _constants.BRANCH:  # the parser takes out what all ways begin with
            ways = [_needed([*run, *way], known) for way in value[1]]
            if all(ways):
                out.append(frozenset().union(*(_best(way, known) for way in ways)))
        run = []
    return out


def keywords(pattern: str) -> list[str]:
    """Literals of which every match of a pattern holds one."""
    return sorted(_best(_needed(list(_parser.parse(pattern)), []), []))


def gates() -> list[str]:
    """Words of which every match of every rule holds one, but for those that match CC_BY."""
    out = list(COMMON)
    for label, _, _, pattern in rules():
        best = _best(_needed(list(_parser.parse(pattern)), out), out)
        if not label.startswith("cc-by") and not _held(best, out):
            out += sorted(best)
    return out


def rules() -> list[tuple[str, int, list[str], str]]:
    """Label, priority, keywords and pattern, in order."""
    out = []
    for label, tag, name, address in [*LICENSES, *_creative_commons()]:
        end = r"(?![a-z0-9])"
        out += [
            (label, 4, rf"spdx-license-identifier:\s*{tag.replace('.', '[.]')}(?:-only|-or-later|\+)?{end}"),
            (label, 4, address),
            (label, 3, rf"(?:licen[cs]ed|released|distributed|available|made\s+available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{name}){end}"),
            (label, 2, rf"(?<![a-z0-9])(?:{name}){end}"),
        ]
    return [(label, priority, keywords(pattern), pattern) for label, priority, pattern in out + NOTICES]


RULE = "array<struct<label:string,priority:int,keywords:array<string>,pattern:string>>"
FOUND = "start:bigint,end:bigint,label:string,priority:int"


def _rule_table() -> Column:
    """The rules as one constant array."""
    names = ("label", "priority", "keywords", "pattern")
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rules()])), RULE)


def _keep(found: Column) -> Column:
    """Detections, by start, that lie within no other of at least their priority; of equals the first stays.

    They come by start, longest and highest first, so one lies within an earlier one exactly if an earlier
    one of at least its priority ends no sooner: one furthest end for each priority is enough.
    """
    top = max(CONFIDENCE)
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("rank"), d["label"].alias("label"))))
    first = F.struct(F.array_repeat(F.lit(-1).cast("bigint"), top).alias("ends"), F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int>>").alias("out"))

    def step(state: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["rank"]
        inside = F.array_max(F.slice(state["ends"], priority, top)) >= end
        ends = F.transform(state["ends"], lambda e, i: F.when((i + 1 == priority) & (e < end), end).otherwise(e))
        row = F.struct(d["start"].alias("start"), end.alias("end"), d["label"].alias("label"), priority.alias("priority"))
        return F.struct(ends.alias("ends"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(row))).alias("out"))

    return F.aggregate(ordered, first, step, lambda state: state["out"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    ``found`` lists start, end (code points of the lower-case text), label and priority of the detections
    kept; the score is the surest one's confidence. Null texts are empty; null and repeated doc_ids are
    kept; an empty table gives no rows. One pass, no shuffle.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("low"))
    low = F.col("low")
    phrase = rf"(?<!{WORD})(?:{'|'.join(GAP.join(p.split()) for p in PHRASES)})(?!{WORD})"
    own_of = lambda m: F.coalesce(*[F.when(m.startswith(p.split()[0]), F.lit(label)) for p, label in PHRASES.items()])
    base = spans(low, F.lit(phrase), lambda m: {"label": own_of(m)}, "label string", count=F.lit(WORD + "+"))
    active = F.filter(_rule_table(), lambda r: F.exists(r["keywords"], lambda k: F.contains(low, k)) & F.rlike(low, r["pattern"]))
    hits = F.flatten(F.transform(active, lambda r: spans(low, r["pattern"], lambda m: {"label": r["label"], "priority": r["priority"]}, "label string, priority int")))
    gate = low.rlike(CC_BY)
    for word in gates():
        gate = gate | low.contains(word)
    rows = rows.withColumns({
        "n_words": F.regexp_count("low", F.lit(WORD + "+")).cast("long"),
        "base": F.when(low.rlike(phrase), base).otherwise(none("start:bigint,end:bigint,index:bigint,label:string")),
        "hits": F.when(gate, hits).otherwise(none(FOUND)),
    })
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, _keep(F.col("hits"))).otherwise(F.col("hits")))
    named = F.transform("base", lambda b: b["label"])
    told = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.transform("found", lambda d: F.get(F.array(*[F.lit(CONFIDENCE[k]) for k in sorted(CONFIDENCE)]), d["priority"] - 1))
    score = F.coalesce(F.array_max(sure), F.when(F.size("base") > 0, F.lit(CONFIDENCE[2])), F.lit(0.0))
    index = F.transform("base", lambda b: b["index"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(index).alias("first_word"), F.array_max(index).alias("last_word"),
        told(named).alias("base_labels"), told(F.concat(named, F.transform("found", lambda d: d["label"]))).alias("labels"), score.alias("score"), "found",
    )


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License mentions of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
