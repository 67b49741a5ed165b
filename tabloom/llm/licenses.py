"""License scans with ordered signature rules, as DataFrame functions only.

Phrases: places where the words of a phrase stand consecutively, words being runs of
ASCII letters, digits and any non-ASCII character, A-Z as a-z.

Signatures: a few hundred regular expressions, made from the hand-written names,
identifiers and addresses below in the wordings that notices use (full notice, licence
reference, identifier tag, address, plain name).  A text is looked at only if it holds one of the families'
keywords, and a family's rules run only on texts that hold that family's keyword.
Keywords and rules see a flat copy of the text, where white space, and the comment marks
that begin or end a line, are one blank: notices are mostly wrapped.
Detections are ordered by start, longest first; one that lies inside a detection of
the same or a better priority is suppressed, so a plain name inside a full notice, or
a short version of an identifier inside a longer one, doesn't count.

Inputs: a null text is empty: no words, no places, no labels; null ids, repeated rows
and texts of any length keep a row each; other columns are ignored."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"   # of words; patterns ignore the case of A-Z

# white space that is more than a blank, with the comment marks at the line's end (box comments) and at the next one's start
SPACE = r"\s\x{85}\x{A0}\x{2028}\x{2029}"
MARK = r"(?:[#*;%>|!']+/?|//+[*!]?|/\*+!?|--+|::|<!--|\(\*|\.?\\\x22|@c|(?i:dnl|rem))"
WRAPPED = (rf"(?=[{SPACE}])(?:[ \t]*+(?:(?<=[ \t])[#*|;]++[ \t]*+)?[\r\n\x0B\f\x{{85}}\x{{2028}}\x{{2029}}][{SPACE}]*+"
           rf"(?:{MARK}(?=[{SPACE}])[{SPACE}]++)*+|[{SPACE}]{{2,}}+|[\t\x{{A0}}])")

# label, keywords (lower case, "|" between) one of which every name holds, names in notices, identifier prefix, address; regular expressions in the last three
FAMILIES = (
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e,? (?:version )?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e,? (?:version |v)?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit licen", r"(?:the )?mit licen[cs]e", r"mit", r"opensource\.org/licenses/mit"),
    ("mit-0", "mit no attribution", r"mit no attribution", r"mit-0", r"opensource\.org/licenses/mit-0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|(?:2|two)[- ]clause bsd|bsd (?:2|two)[- ]clause) licen[cs]e", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised) bsd|(?:3|three)[- ]clause bsd|bsd (?:3|three)[- ]clause) licen[cs]e", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|(?:4|four)[- ]clause bsd|bsd (?:4|four)[- ]clause) licen[cs]e", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", "bsd", r"(?:zero[- ]clause bsd|bsd zero[- ]clause) licen[cs]e", r"0bsd", r"opensource\.org/licenses/0bsd"),
    ("isc", "isc licen", r"isc licen[cs]e", r"isc", r"opensource\.org/licenses/isc"),
    ("gpl-1.0", "general public", r"gnu general public licen[cs]e,? (?:version |v)1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("gpl-2.0", "general public", r"gnu general public licen[cs]e,? (?:version |v)2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"gnu general public licen[cs]e,? (?:version |v)3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "general public|gnu gpl", r"gnu (?:general public licen[cs]e|gpl)", r"gpl", r"gnu\.org/licenses/gpl\.html"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e,? (?:version |v)2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e,? (?:version |v)3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e", r"lgpl", r"gnu\.org/licenses/lgpl\.html"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v)3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation licen[cs]e(?:,? (?:version |v)1\.\d)?", r"gfdl-1\.\d(?:-only|-or-later)?", r"gnu\.org/licenses/fdl-1\.3"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v(?:\. )?)?2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: -)?,? (?:version |v)?1\.0", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: -)?,? (?:version |v)?2\.0", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?:,? (?:version |v)?1\.0)?", r"cddl-1\.0", r"opensource\.org/licenses/cddl-1\.0"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?:,? (?:version |v)?1\.0)?", r"cpl-1\.0", r"opensource\.org/licenses/cpl1\.0"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?:,? (?:version |v)?1\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses/artistic-2\.0"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?:,? (?:version |v)?1(?:\.0)?)?", r"artistic-1\.0", r"opensource\.org/licenses/artistic-1\.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", r"opensource\.org/licenses/zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "do what the", r"do what the f\w{3} you want to public licen[cs]e", r"wtfpl", r"wtfpl\.net"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: \d\.\d)?(?: international| generic| unported)?", r"cc-by-\d\.\d", r"creativecommons\.org/licenses/by/\d\.\d"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share ?alike(?: \d\.\d)?", r"cc-by-sa-\d\.\d", r"creativecommons\.org/licenses/by-sa/\d\.\d"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[- ]no ?deriv(?:ative|ative work)?s(?: \d\.\d)?", r"cc-by-nd-\d\.\d", r"creativecommons\.org/licenses/by-nd/\d\.\d"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non ?commercial(?: \d\.\d)?", r"cc-by-nc-\d\.\d", r"creativecommons\.org/licenses/by-nc/\d\.\d"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution[- ]non ?commercial[- ]share ?alike(?: \d\.\d)?", r"cc-by-nc-sa-\d\.\d", r"creativecommons\.org/licenses/by-nc-sa/\d\.\d"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution[- ]non ?commercial[- ]no ?derivatives(?: \d\.\d)?", r"cc-by-nc-nd-\d\.\d", r"creativecommons\.org/licenses/by-nc-nd/\d\.\d"),
    ("ofl-1.1", "open font", r"sil open font licen[cs]e(?:,? (?:version |v)?1\.1)?", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open data", r"open data commons open database licen[cs]e(?: (?:version |v)?1\.0)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "open data", r"open data commons attribution licen[cs]e(?: (?:version |v)?1\.0)?", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain", r"public domain dedication and licen[cs]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("public-domain", "public domain", r"(?:placed in|released into|dedicated to|in) the public domain", r"licenseref-public-domain", r"creativecommons\.org/licenses/publicdomain"),
    ("psf-2.0", "python software", r"python software foundation licen[cs]e(?:,? (?:version |v)?2)?", r"psf-2\.0|python-2\.0", r"docs\.python\.org/\d/license"),
    ("php-3.01", "php licen", r"php licen[cs]e,? (?:version |v)?3\.01", r"php-3\.01", r"php\.net/license/3_01"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql\.org/about/licence"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", r"openssl\.org/source/license"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?:,? (?:version |v)?(?:\. )?1\.[12])?", r"eupl-1\.[12]", r"joinup\.ec\.europa\.eu/\S{1,40}eupl"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?:,? (?:version |v)?1\.0)?", r"upl-1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[cs]e", r"ncsa", r"opensource\.org/licenses/ncsa"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?:,? (?:version |v)?(?:\. )?3\.0)?", r"afl-3\.0", r"opensource\.org/licenses/afl-3\.0"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?:,? (?:version |v)?(?:\. )?3\.0)?", r"osl-3\.0", r"opensource\.org/licenses/osl-3\.0"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?:,? (?:version |v)?1)?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?:,? (?:version |v)?1\.1)?", r"busl-1\.1", r"mariadb\.com/bsl11"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|proprietary licen[cs]e|confidential and proprietary)", r"licenseref-proprietary", r"licenses/proprietary"),
    ("copyright", "copyright", r"(?:copyright (?:\(c\)|©)|© copyright|\(c\) copyright) ?(?:19|20)\d\d", r"licenseref-copyright", r"licenses/copyright"),
)

# wording: (priority, confidence, pattern, keywords); {name}, {tag} and {url} stand for a family's
# own expressions; no keywords: those of the family (names) or the fixed start of its address
WORDINGS = (
    (1, 1.0, r"(?:licen[cs]ed|released|distributed|available|published) (?:under|with) (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?", ""),
    (1, 1.0, r"spdx-license-identifier: ?(?:{tag})(?![\w.-])", "spdx-license-identifier"),
    (2, 0.9, r"(?:https?://)?(?:www\.)?(?:{url})", "url"),
    (2, 0.8, r"licen[cs]e[:=] ?[\x22']?(?:{tag}|{name})(?![\w-])", "license:|licence:|license=|licence="),
    (3, 0.6, r"(?<!\w)(?:{name})(?!\w)", ""),
)
RULE = "struct<keys:array<string>,priority:int,sure:double,pattern:string,label:string>"
DETECTION = "array<struct<start:int,less:int,priority:int,finish:int,sure:double,label:string>>"


def rules() -> list[dict]:
    """Every signature, in order: keywords of the prefilter, priority, confidence, pattern, label."""
    out = []
    for label, keys, name, tag, url in FAMILIES:
        for priority, sure, wording, own in WORDINGS:
            fixed = re.split(r"[\\(\[?]", url)[0] if own == "url" else own or keys
            out.append({"keys": fixed.split("|"), "priority": priority, "sure": sure, "label": label,
                        "pattern": "(?i)" + wording.format(name=name, tag=tag, url=url)})
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, n_words: Column, phrase: str) -> Column:
    """(n, first, last) of a phrase in ``words``: a text ' w1 w2 ... wn ' of single blanks."""
    size = len(phrase.split())
    return _let(F.split(words, f"(?i) {phrase}(?= )", -1), lambda p: F.struct(
        (F.size(p) - 1).cast("long").alias("n"),
        F.when(F.size(p) > 1, _blanks(F.get(p, F.lit(0)))).cast("long").alias("first"),
        F.when(F.size(p) > 1, n_words - (_blanks(F.element_at(p, -1)) - 1) - size).cast("long").alias("last")))


def _detections(text: Column, rule: Column) -> Column:
    """All matches of a rule: the text between matches tells where they start."""
    pieces = F.arrays_zip(F.split(text, rule["pattern"], -1).alias("gap"),
                          F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,l:int>>").alias("spans"))
    spans = F.aggregate(pieces, start, lambda a, x: F.struct(
        (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))).alias("at"),
        F.when(x["found"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct(
            (a["at"] + F.length(x["gap"])).alias("s"), F.length(x["found"]).alias("l"))))).alias("spans")),
        lambda a: a["spans"])
    return F.transform(spans, lambda s: F.struct(
        s["s"].alias("start"), (-s["l"]).alias("less"), rule["priority"].alias("priority"),
        (s["s"] + s["l"]).alias("finish"), rule["sure"].alias("sure"), rule["label"].alias("label")))


def _surviving(found: Column) -> Column:
    """(labels, sure) of the detections that lie inside none of the same or a better priority."""
    zero = F.struct(*(F.lit(-1).alias(f"e{p}") for p in (1, 2, 3)),
                    F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure"))

    def step(a: Column, x: Column) -> Column:
        best = F.when(x["priority"] == 1, a["e1"]).when(x["priority"] == 2, F.greatest(a["e1"], a["e2"])) \
            .otherwise(F.greatest(a["e1"], a["e2"], a["e3"]))
        ends = [F.when(x["priority"] == p, F.greatest(a[f"e{p}"], x["finish"])).otherwise(a[f"e{p}"]).alias(f"e{p}")
                for p in (1, 2, 3)]
        return F.when(best >= x["finish"], a).otherwise(F.struct(
            *ends, F.array_union(a["labels"], F.array(x["label"])).alias("labels"),
            F.greatest(a["sure"], x["sure"]).alias("sure")))
    return F.aggregate(F.array_sort(found), zero, step, lambda a: F.struct(
        a["labels"].alias("labels"), a["sure"].alias("sure")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row;
    labels as sorted arrays."""
    signatures = F.from_json(F.lit(json.dumps(rules())), f"array<{RULE}>")
    keys = sorted({k for r in rules() for k in r["keys"]}, key=lambda k: (len(k), k))
    gates = [k for i, k in enumerate(keys) if not any(x in k for x in keys[:i])]   # a key holding another is implied
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("flat", F.regexp_replace("text", WRAPPED, " ")).withColumn("lower", F.lower("text")).withColumn(
        "flat_lower", F.lower("flat")).withColumn(
        "words", F.regexp_replace(F.concat(F.lit(" "), "text", F.lit(" ")), SEPARATORS, " "))
    rows = rows.withColumn("n_words", (_blanks(F.col("words")) - 1).cast("long"))
    nowhere = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"),
                       F.lit(None).cast("long").alias("last"))
    for i, phrase in enumerate(PHRASES):
        may = [F.col("lower").contains(w) for w in phrase.split()]
        rows = rows.withColumn(f"p{i}", F.when(reduce(Column.__and__, may), _places(
            F.col("words"), F.col("n_words"), phrase)).otherwise(nowhere))
    present = F.filter(signatures, lambda r: F.exists(r["keys"], lambda k: F.col("flat_lower").contains(k)))
    found = F.flatten(F.transform(present, lambda r: _detections(F.col("flat"), r)))
    none = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure"))
    rows = rows.withColumn("method", F.when(F.col("flat_lower").rlike("|".join(map(re.escape, gates))),
                                            _surviving(found)).otherwise(none))
    places = [F.col(f"p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*(F.when(p["n"] > 0, F.lit(label)) for p, label in zip(places, PHRASES.values()))))
    n_base = reduce(Column.__add__, [p["n"] for p in places])
    return rows.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.least(*(p["first"] for p in places)).alias("first_word"),
        F.greatest(*(p["last"] for p in places)).alias("last_word"), F.array_sort(base).alias("base_labels"),
        F.array_sort(F.array_union(base, "method.labels")).alias("labels"),
        F.greatest(F.col("method.sure"), F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"))
