"""License scans by sentence rules.

A text is cut into sentences, each is normalised and mapped to the identifiers of
the known licence sentences in it, in order of place (of overlapping matches the
one listed first wins); the sequence of identifiers is then matched against
ordered rules, longest evidence first. Identifiers that a rule uses up are gone
for later rules; what no rule explains is reported as unmatched. A reservation of all rights
in the copyright line ahead of a licence belongs to that licence. A licence that a
sentence refuses ("not licensed under ...") has no identifier.

Results for odd input: a null or empty text has no sentences and no licence;
very long texts are scanned whole, line by line; repeated sentences count each
time; repeated rows give repeated results; an empty table gives an empty table;
further columns are not read, whatever they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import texts

#: An identifier after an operator of an SPDX expression: it has a digit or a hyphen, or is one of the plain names, so prose is none.
_SPDX_ID = r"([a-z0-9.+:]*[0-9-][a-z0-9.+:-]*|mit|isc|zlib|curl|ftl|json|ncsa|ruby|tcl|unlicense|vim|wtfpl|beerware|openssl)(?![a-z0-9.+:-])"

# Known licence sentences, as patterns over the normalised sentence. Where matches overlap, the first listed wins.
SENTENCES = (
    ("SPDXNamed", rf"spdx-license-identifier: ?(?P<name>\(*[a-z0-9.+:-]+\)*( (and|or|with) \(*{_SPDX_ID}\)*)*)"),
    ("ApacheLicensed", r"(licensed (to you )?under|under either of|\band|\bor) (the )?apache license,? version 2(\.0)?"),
    ("ApacheCompliance", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing,? software distributed under the license"),
    ("MITReleased", r"((released|licensed|distributed|available) under|under either of|\band|\bor) (the )?(terms of the )?(mit|expat) license"),
    ("MITPermission", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included"),
    ("MITAsIs", r"the software is provided \"?as is\"?,? without warranty of any kind"),
    ("BSLPermission", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy"),
    ("ISCPermission", r"permission to use,? copy,? modify,? and(/or)? distribute this software for any purpose"),
    ("BSDRedistribution", r"redistribution and use in source and binary forms,? with or without modification"),
    ("BSDSource", r"redistributions of source code must retain the above copyright"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright"),
    ("BSDAdvertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BSDEndorse", r"neither the names? of .{0,300}? may be used to endorse or promote"),
    ("BSDAsIs", r"this software is provided by .{0,300}? \"?as is\"?"),
    ("ZlibAsIs", r"this software is provided ['\"]?as[- ]is['\"]?,? without any express or implied warranty"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented"),
    ("ZlibAltered", r"altered source versions must be plainly marked as such"),
    ("BSD2Named", r"licensed under (the )?((simplified |2-clause |two-clause )bsd|bsd[ -](2|two)-clause)( license)?"),
    ("BSD4Named", r"licensed under (the )?((original |4-clause |four-clause )bsd|bsd[ -](4|four)-clause)( license)?"),
    ("BSDNamed", r"licensed under (the )?((new |modified |3-clause |three-clause )?bsd|bsd[ -](3|three)-clause)( license)?"),
    ("AGPLDetails", r"see the gnu affero general public license for more details"),
    ("AGPLCopy", r"you should have received a copy of the gnu affero general public license"),
    ("LGPLDetails", r"see the gnu (lesser|library) general public license for more details"),
    ("LGPLCopy", r"you should have received a copy of the gnu (lesser|library) general public license"),
    ("GPLDetails", r"see the gnu general public license for more details"),
    ("GPLCopy", r"you should have received a copy of the gnu general public license"),
    ("LGPL21Named", r"(version 2\.1 of the gnu lesser general public license|gnu lesser general public license,? (version |v)?2\.1)"),
    ("LGPL3Named", r"(version 3(\.0)? of the gnu lesser general public license|gnu lesser general public license,? (version |v)?3(\.0)?)"),
    ("AGPLNamed", r"gnu affero general public license"),
    ("LGPLNamed", r"gnu (lesser|library) general public license"),
    ("GPLFree", r"this (program|library) is free software[:;]? you can redistribute it and/or modify"),
    ("GPL1Later", r"either version 1(\.0)? of the license,? or \(?at your option\)? any later version"),
    ("GPL2Later", r"either version 2(\.0)? of the license,? or \(?at your option\)? any later version"),
    ("GPL21Later", r"either version 2\.1 of the license,? or \(?at your option\)? any later version"),
    ("GPL3Later", r"either version 3(\.0)? of the license,? or \(?at your option\)? any later version"),
    ("GPLLater", r"either version (\d(\.\d)?) of the license,? or \(?at your option\)? any later version"),
    ("GPL3Named", r"(version 3 of the gnu general public license|gnu general public license,? (version |v)?3)"),
    ("GPL2Named", r"(version 2 of the gnu general public license|gnu general public license,? (version |v)?2)"),
    ("GPLNamed", r"gnu general public license"),
    ("MPLNamed", r"mozilla public license,? (version |v\. ?|v)?2(\.0)?"),
    ("CC0Named", r"(cc0( 1\.0)?|creative commons zero|public domain dedication)"),
    ("EPL1Named", r"eclipse public license,?( -)? (version |v\.? ?)?1(\.0)?"),
    ("EPL2Named", r"eclipse public license,?( -)? (version |v\.? ?)?2(\.0)?"),
    ("BSLNamed", r"boost software license"),
    ("ZlibNamed", r"(licensed|released|distributed) under (the )?(terms of the )?zlib license"),
    ("CCBYNCSANamed", r"(cc[ -]by-nc-sa|creative commons attribution[ -]non-?commercial[ -]share-?alike)"),
    ("CCBYNCNDNamed", r"(cc[ -]by-nc-nd|creative commons attribution[ -]non-?commercial[ -]no-?deriv)"),
    ("CCBYNCNamed", r"(cc[ -]by-nc|creative commons attribution[ -]non-?commercial)"),
    ("CCBYSANamed", r"(cc[ -]by-sa|creative commons attribution[ -]share-?alike)"),
    ("CCBYNDNamed", r"(cc[ -]by-nd|creative commons attribution[ -]no-?deriv)"),
    ("CCBYNamed", r"(cc[ -]by|creative commons attribution)"),
    ("UnlicenseNamed", r"this is free and unencumbered software released into the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright( \(c\)| ©)? ?\d{4}"),
    ("SeeLicense", r"(see|found in) the license( file)?"),
)

# The GNU headers, the name of the licence that each gives, and the paragraphs that usually follow.
_GNU = (
    (("GPLFree", "AGPLNamed", "GPL3Later"), "AGPL-3.0-or-later"),
    (("GPLFree", "LGPLNamed", "GPL21Later"), "LGPL-2.1-or-later"),
    (("GPLFree", "LGPLNamed", "GPL2Later"), "LGPL-2.0-or-later"),
    (("GPLFree", "LGPLNamed", "GPL3Later"), "LGPL-3.0-or-later"),
    (("GPLFree", "GPL3Named", "GPL3Later"), "GPL-3.0-or-later"),
    (("GPLFree", "GPL3Named", "GPLLater"), "GPL-3.0-or-later"),
    (("GPLFree", "GPLNamed", "GPL3Later"), "GPL-3.0-or-later"),
    (("GPLFree", "GPL2Named", "GPL2Later"), "GPL-2.0-or-later"),
    (("GPLFree", "GPLNamed", "GPL2Later"), "GPL-2.0-or-later"),
    (("GPLFree", "GPLNamed", "GPL1Later"), "GPL-1.0-or-later"),
    (("GPLFree", "GPLNamed", "GPLLater"), "GPL"),
    (("GPLFree", "AGPLNamed"), "AGPL-3.0"),
    (("GPLFree", "LGPLNamed"), "LGPL"),
    (("GPLFree", "GPL3Named"), "GPL-3.0"),
    (("GPLFree", "GPL2Named"), "GPL-2.0"),
    (("GPLFree", "GPLNamed"), "GPL"),
    (("GPLFree", "LGPL21Named", "GPL21Later"), "LGPL-2.1-or-later"),
    (("GPLFree", "LGPL3Named", "GPL3Later"), "LGPL-3.0-or-later"),
    (("LGPL21Named",), "LGPL-2.1"),
    (("LGPL3Named",), "LGPL-3.0"),
    (("AGPLNamed",), "AGPL-3.0"),
    (("LGPLNamed",), "LGPL"),
    (("GPL3Named",), "GPL-3.0"),
    (("GPL2Named",), "GPL-2.0"),
    (("GPLNamed",), "GPL"),
    ((), "AGPL-3.0"),
    ((), "LGPL"),
    ((), "GPL"),
)


def _with_tails(header: tuple[str, ...], licence: str) -> list[tuple[tuple[str, ...], str]]:
    """A header with the paragraphs that may follow it, the fullest form first."""
    kind = licence.partition("-")[0]
    tails = ((f"{kind}Details", f"{kind}Copy"), (f"{kind}Details",), (f"{kind}Copy",), ())
    return [(header + t, licence) for t in tails if header + t]


# Ordered rules. A rule's identifiers must occur in this order (others may lie between); it names the licence.
RULES = (
    (("ApacheLicensed", "ApacheCompliance", "ApacheCopy", "ApacheAsIs"), "Apache-2.0"),
    (("ApacheCompliance", "ApacheCopy", "ApacheAsIs"), "Apache-2.0"),
    (("BSDRedistribution", "BSDSource", "BSDBinary", "BSDAdvertising", "BSDEndorse", "BSDAsIs"), "BSD-4-Clause"),
    (("BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"), "BSD-3-Clause"),
    (("BSDRedistribution", "BSDSource", "BSDBinary", "BSDAsIs"), "BSD-2-Clause"),
    (("MITPermission", "MITNotice", "MITAsIs"), "MIT"),
    (("BSLNamed", "BSLPermission"), "BSL-1.0"),
    (("ZlibAsIs", "ZlibOrigin", "ZlibAltered"), "Zlib"),
    *(rule for header in _GNU for rule in _with_tails(*header)),
    (("ISCPermission", "MITAsIs"), "ISC"),
    (("ApacheLicensed",), "Apache-2.0"),
    (("MITReleased",), "MIT"),
    (("MITPermission",), "MIT"),
    (("ISCPermission",), "ISC"),
    (("BSD2Named",), "BSD-2-Clause"),
    (("BSD4Named",), "BSD-4-Clause"),
    (("BSDNamed",), "BSD-3-Clause"),
    (("MPLNamed",), "MPL-2.0"),
    (("EPL2Named",), "EPL-2.0"),
    (("EPL1Named",), "EPL-1.0"),
    (("BSLPermission",), "BSL-1.0"),
    (("BSLNamed",), "BSL-1.0"),
    (("ZlibNamed",), "Zlib"),
    (("ZlibOrigin", "ZlibAltered"), "Zlib"),
    (("CC0Named",), "CC0-1.0"),
    (("CCBYNCSANamed",), "CC-BY-NC-SA"),
    (("CCBYNCNDNamed",), "CC-BY-NC-ND"),
    (("CCBYNCNamed",), "CC-BY-NC"),
    (("CCBYSANamed",), "CC-BY-SA"),
    (("CCBYNDNamed",), "CC-BY-ND"),
    (("CCBYNamed",), "CC-BY"),
    (("UnlicenseNamed",), "Unlicense"),
    (("SPDXNamed",), "SPDX"),
    (("AllRights",), "Proprietary"),
)

#: A licence that is named behind one of these words is refused, not granted: its identifier is not given.
_REFUSED = re.compile(r"(\bnot|\bnever|\bno longer|n't|\bneither|\bcannot be)\b[^,;:()]{0,40}$")
#: Characters ahead of a name in which such a word and what may follow it lie.
_REFUSED_SPAN = 60
_NAMING = re.compile(r".*(Named|Licensed|Released)$")

#: SPDX names by their lower case, for one spelling of a licence however a text names it.
_SPELLINGS = {name.lower(): name for _, name in RULES} | {
    f"{kind}-{version}{form}".lower(): f"{kind}-{version}{form}"
    for kind, versions in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("1.0", "3.0")))
    for version in versions
    for form in ("", "-only", "-or-later", "+")
}
# Exceptions to a licence.
EXCEPTIONS = ("Classpath-exception-2.0", "LLVM-exception", "GCC-exception-2.0", "GCC-exception-3.1", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "Linux-syscall-note")
_SPELLINGS |= {name.lower(): name for name in EXCEPTIONS}

_KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
#: A line without any of these strings has no known sentence.
_HINT = re.compile(
    r"licen[sc]e|copyright|all\s+rights\s+reserved|redistribut|permission|public\s+domain|without\s+warranty|\bcc[ -]?(by|0)|creative\s+commons|provided\s+by|neither\s+the\s+names?|either\s+version|free\s+software|unencumbered|advertising\s+materials|implied\s+warranty|misrepresented|plainly\s+marked",
    re.IGNORECASE,
)
_END = re.compile(r"(?<=[.;!?])\s+(?=[A-Z\"(0-9])|(?<=:)\s*\n\s*|\n\s*\n")
_COMMENT = re.compile(r"(?m)^[ \t]*(#+|//+|/\*+|\*+/?|--+|;+)[ \t]?")


def normalise(sentence: str) -> str:
    """Lower case, single spaces, plain quotes, no full stop at the end, ``licence`` spelt ``license``."""
    s = re.sub(r"[“”„‟«»]", '"', sentence.lower())
    s = s.replace("cc by ", "cc-by-").replace("licence", "license")
    return re.sub(r"\s+", " ", s).strip(" .;!?")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text without comment marks."""
    out, begin = [], 0
    for m in _END.finditer(text):
        out.append((begin, m.start()))
        begin = m.end()
    out.append((begin, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def known(plain: str) -> list[tuple[str, str]]:
    """(identifier, named part) of all known sentences in a normalised one, in order of place; an SPDX expression gives one a licence."""
    # spans that are taken, in order of place: only the neighbours of a new one can overlap it
    spans: list[tuple[int, int, str, str]] = []
    for name, pattern in _KNOWN:
        for hit in pattern.finditer(plain):
            begin, end = hit.span()
            if _NAMING.match(name) and _REFUSED.search(plain, max(0, begin - _REFUSED_SPAN), begin):
                continue
            at = bisect_left(spans, (begin,))
            if (at == 0 or spans[at - 1][1] <= begin) and (at == len(spans) or end <= spans[at][0]):
                spans.insert(at, (begin, end, name, hit.groupdict().get("name") or ""))
    out = []
    for _, _, name, part in spans:
        out += [(name, x.strip(" ().")) for x in re.split(r" (?:and|or) ", part)]
    return out


def identify(text: str) -> list[tuple[str, str]]:
    """(identifier, named part) of the known sentences, in order."""
    return [x for own in identified(text) for x in own]


def identified(text: str) -> list[list[tuple[str, str]]]:
    """(identifier, named part) by sentence, of the sentences that have any. Only stretches around a hint are looked at.

    A stretch runs from the last blank line before a hint to the next one after it,
    so a sentence that is broken over lines is seen whole.
    """
    out, done = [], 0
    for m in _HINT.finditer(text):
        if m.start() < done:
            continue
        begin = max(text.rfind("\n\n", done, m.start()), done)
        end = text.find("\n\n", m.end())
        end = len(text) if end < 0 else end
        done = end
        stretch = _COMMENT.sub("", text[begin:end])
        for a, b in sentences(stretch):
            if not _HINT.search(stretch, a, b):
                continue
            own = known(normalise(stretch[a:b]))
            if own:
                out.append(own)
    return out


def match_rules(found: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The licences, in the order of their first sentence, and the identifiers that no rule explains.

    The copyright line ahead of a licence belongs to it: ``All rights reserved`` there is no licence of its own.
    Places are kept by identifier, in order, so a rule costs a search for each of its identifiers and not the whole sequence.
    """
    places: dict[str, list[int]] = {}
    for at in range(len(found) - 1, -1, -1):
        places.setdefault(found[at][0], []).append(at)
    # the first place of an identifier is the last of its list, so that taking it is cheap
    alive = [True] * len(found)
    got = []

    def take(name: str, at: int) -> None:
        own = places[name]
        del own[bisect_left(own, -at, key=lambda x: -x)]
        alive[at] = False

    for needed, licence in RULES:
        while True:
            used, after = [], -1
            for name in needed:
                own = places.get(name, ())
                # lists fall: what is behind ``after`` comes first
                k = bisect_left(own, -after, key=lambda x: -x) - 1
                if k < 0:
                    break
                after = own[k]
                used.append(after)
            if len(used) < len(needed):
                break
            got.append((used[0], found[used[0]][1] or licence))
            for name, at in zip(needed, used, strict=True):
                take(name, at)
            at = used[0] - 1
            if licence != "Proprietary":
                while at >= 0 and alive[at] and found[at][0] in ("Copyright", "AllRights"):
                    if found[at][0] == "AllRights":
                        take("AllRights", at)
                    at -= 1
    return [x for _, x in sorted(got)], [name for at, (name, _) in enumerate(found) if alive[at]]


def spelt(licence: str) -> str:
    """One spelling of a licence's name: the SPDX one where it is known (expressions part by part), else as it is."""
    parts = [_SPELLINGS.get(part, part) for part in licence.split(" ")]
    return " ".join("WITH" if part == "with" and parts[k + 1 : k + 2] and parts[k + 1] in EXCEPTIONS else part for k, part in enumerate(parts))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, licenses, sentence_ids, unmatched, n_license_sentences). Distinct licences, sorted by first place."""
    kinds = pa.list_(pa.string())
    schema = pa.schema([("doc_id", pa.int64()), ("licenses", kinds), ("sentence_ids", kinds), ("unmatched", kinds), ("n_license_sentences", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                by_sentence = identified(text) if text else []
                found = [x for own in by_sentence for x in own]
                licenses, rest = match_rules(found) if found else ([], [])
                rows.append((list(dict.fromkeys(map(spelt, licenses))), [n for n, _ in found], rest, len(by_sentence)))
            columns = [batch.column(0)] + [pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, licenses array<string>, sentence_ids array<string>, unmatched array<string>, n_license_sentences long"
    )
