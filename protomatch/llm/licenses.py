"""License scan with ordered signature rules, built-in SQL functions only.

Texts are reduced to words (A-Z lower-cased; runs of digits, a-z and non-ASCII
characters). A rule is a regular expression over words, with a keyword that must
occur for the expression to be tried at all, a priority and a confidence: names after
fixed leads (``signature_rules``, a fixed number of words each), and expressions with
optional words, versions and bounded gaps for SPDX ids, short names and the texts of
common licenses (``expression_rules``). Every place of a rule is a detection, an
interval of words; an expression takes as many as it matches. A
detection that lies inside another one is suppressed; of two equal intervals the
rule of higher priority stays. Partly overlapping detections both stay.

Everything happens inside one row: no shuffle, no Python. Defined cases: a null
text is an empty one; an empty text has no words and no labels; repeated rows are
scanned one by one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels that every scan reports.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, expression over the words of the name, keyword inside every match.
NAMES = (
    ("agpl-3.0", "gnu affero general public license", "affero"),
    ("lgpl", "gnu (?:lesser|library) general public license", "general"),
    ("gpl-2.0", "gnu general public license version 2", "general"),
    ("gpl-2.0", "gnu general public license v2", "general"),
    ("gpl-3.0", "gnu general public license version 3", "general"),
    ("gpl-3.0", "gnu general public license v3", "general"),
    ("gfdl", "gnu free documentation license", "documentation"),
    ("gpl", "gnu general public license", "general"),
    ("gpl", "gnu gpl", "gpl"),
    ("apache-2.0", "apache license version 2 0", "apache"),
    ("apache-2.0", "apache license 2 0", "apache"),
    ("apache-1.1", "apache license version 1 1", "apache"),
    ("apache", "apache (?:software )?license", "apache"),
    ("mit", "mit license", "mit"),
    ("mit-0", "mit no attribution license", "attribution"),
    ("bsd-2-clause", "(?:bsd 2 clause|simplified bsd) license", "bsd"),
    ("bsd-3-clause", "bsd 3 clause license", "bsd"),
    ("bsd-3-clause", "(?:new|modified) bsd license", "bsd"),
    ("bsd", "bsd license", "bsd"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla"),
    ("mpl-2.0", "mozilla public license 2 0", "mozilla"),
    ("mpl", "mozilla public license", "mozilla"),
    ("epl-2.0", "eclipse public license 2 0", "eclipse"),
    ("epl", "eclipse public license", "eclipse"),
    ("cddl", "common development and distribution license", "distribution"),
    ("eupl", "european union public license", "european"),
    ("isc", "isc license", "isc"),
    ("zlib", "zlib license", "zlib"),
    ("artistic-2.0", "artistic license 2 0", "artistic"),
    ("artistic", "artistic license", "artistic"),
    ("boost-1.0", "boost software license", "boost"),
    ("python-2.0", "python software foundation license", "python"),
    ("odbl-1.0", "open database license", "database"),
    ("ofl-1.1", "(?:sil )?open font license", "font"),
    ("cc-by-nc-nd", "cc by nc nd", "cc"),
    ("cc-by-nc-sa", "cc by nc sa", "cc"),
    ("cc-by-nc", "cc by nc", "cc"),
    ("cc-by-nd", "cc by nd", "cc"),
    ("cc-by-sa", "cc by sa", "cc"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "cc"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "cc"),
    ("cc-by-4.0", "cc by 4 0", "cc"),
    ("cc-by", "cc by", "cc"),
    ("cc-by", "creative commons attribution", "creative"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative"),
    ("cc-by-sa", "creative commons attribution share alike", "creative"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative"),
    ("cc0", "creative commons zero", "creative"),
)

# Words before a name, priority (smaller wins), confidence.
LEADS = (
    ("spdx license identifier", 0, 1.0),
    ("licensed under", 1, 0.95),
    ("licensed under the", 1, 0.95),
    ("under the terms of the", 1, 0.95),
    ("(?:released|distributed) under the", 2, 0.9),
    ("subject to the", 2, 0.9),
    ("", 3, 0.75),
)

# After a version, in place of "@later".
LATER = "(?: only| or later| or at your option any later version| or any later version)?"
# Lead of an id.
TAG = "spdx license identifier"


def _version(major: int, minor: str = "0", needed: bool = False) -> str:
    """A version as it is written after a name: 2, 2 0, v2, v 2 0, version 2 0; the minor number may be needed."""
    return f"(?:(?:version |v |v|ver )?{major}(?: {minor}){'' if needed else '?'})"


# Ids as SPDX writes them: label, expression over the words of the id.
IDS = (
    ("agpl-1.0", "agpl 1 0(?: only| or later)?"), ("agpl-3.0", f"agpl {_version(3)}(?: only| or later)?"),
    ("lgpl-2.0", f"lgpl {_version(2)}(?: only| or later)?"), ("lgpl-2.1", f"lgpl {_version(2, '1', True)}(?: only| or later)?"),
    ("lgpl-3.0", f"lgpl {_version(3)}(?: only| or later)?(?: with [^ ]+ exception)?"), ("lgpllr", "lgpllr"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", f"gpl {_version(2)}(?: only| or later)?(?: with [^ ]+ exception(?: [0-9] [0-9])?)?"),
    ("gpl-3.0", f"gpl {_version(3)}(?: only| or later)?(?: with [^ ]+ exception(?: [0-9] [0-9])?)?"),
    ("gfdl", "gfdl 1 [1-3](?: (?:no )?invariants)?(?: only| or later)?"),
    ("apache-1.0", "apache 1 0"), ("apache-1.1", "apache 1 1"), ("apache-2.0", f"apache {_version(2)}(?: with llvm exception)?"),
    ("mit-0", "mit 0"), ("mit", "mit"), ("mit-modern", "mit modern variant"), ("mit-cmu", "mit cmu"), ("mit-advertising", "mit advertising"),
    ("0bsd", "0bsd"), ("bsd-1-clause", "bsd 1 clause"), ("bsd-2-clause", "bsd 2 clause(?: patent| views| darwin)?"),
    ("bsd-3-clause", "bsd 3 clause(?: clear| lbnl| attribution| modification| open mpi)?"), ("bsd-4-clause", "bsd 4 clause(?: shortened| uc)?"),
    ("bsd-protection", "bsd protection"), ("bsd-source-code", "bsd source code"),
    ("mpl-1.0", "mpl 1 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0(?: no copyleft exception)?"), ("npl", "npl 1 [01]"),
    ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("cpl-1.0", "cpl 1 0"), ("ipl-1.0", "ipl 1 0"),
    ("cddl-1.0", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("cpal-1.0", "cpal 1 0"), ("apsl", "apsl [12] [0-2]"), ("spl-1.0", "spl 1 0"),
    ("eupl", "eupl 1 [0-2]"), ("cecill", "cecill (?:1 [01]|2 [01]|b|c)"), ("isc", "isc"), ("zlib", "zlib(?: acknowledgement)?"),
    ("libpng", "libpng(?: 2 0)?"), ("libtiff", "libtiff"), ("ijg", "ijg(?: short)?"), ("artistic-2.0", "artistic 2 0"), ("artistic", "artistic 1 0(?: perl| cl8)?"),
    ("clartistic", "clartistic"), ("boost-1.0", "bsl 1 0"), ("busl-1.1", "busl 1 1"), ("elastic-2.0", "elastic 2 0"), ("sspl-1.0", "sspl 1 0"),
    ("python-2.0", "(?:psf|python) 2 0(?: 1)?"), ("cnri-python", "cnri python(?: gpl compatible)?"), ("ruby", "ruby"), ("php", "php 3 01?"), ("zend-2.0", "zend 2 0"),
    ("tcl", "tcl"), ("vim", "vim"), ("curl", "curl"), ("openssl", "openssl(?: standalone)?"), ("postgresql", "postgresql"), ("sleepycat", "sleepycat"),
    ("icu", "icu"), ("unicode", "unicode (?:3 0|dfs 201[56]|tou)"), ("ncsa", "ncsa"), ("ntp", "ntp(?: 0)?"), ("hpnd", "hpnd(?: sell variant)?"),
    ("x11", "x11(?: distribute modifications variant)?"), ("w3c", "w3c(?: 19980720| 20150513)?"), ("afl", "afl (?:1 [12]|2 [01]|3 0)"), ("osl", "osl (?:1 [01]|2 [01]|3 0)"),
    ("ecl", "ecl [12] 0"), ("efl", "efl [12] 0"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("mulan-psl", "mulanpsl [12] 0"), ("blueoak-1.0.0", "blueoak 1 0 0"),
    ("lppl", "lppl 1 (?:[0-2]|3[ac])"), ("lpl", "lpl 1 (?:0|02)"), ("nasa-1.3", "nasa 1 3"), ("nposl-3.0", "nposl 3 0"), ("oldap", "oldap [12] [0-9](?: [0-9])?"),
    ("qpl-1.0", "qpl 1 0"), ("rpl", "rpl 1 [15]"), ("rpsl-1.0", "rpsl 1 0"), ("sgi-b", "sgi b (?:1 [01]|2 0)"), ("sissl", "sissl(?: 1 2)?"), ("upl-1.0", "upl 1 0"),
    ("zpl", "zpl (?:1 1|2 [01])"), ("vsl-1.0", "vsl 1 0"), ("watcom-1.0", "watcom 1 0"), ("beerware", "beerware"), ("json", "json"), ("ftl", "ftl"), ("bzip2", "bzip2 1 0 [56]"),
    ("odbl-1.0", "odbl 1 0"), ("pddl-1.0", "pddl 1 0"), ("odc-by-1.0", "odc by 1 0"), ("ogl-uk", "ogl uk [123] 0"), ("ofl-1.0", "ofl 1 0(?: rfn| no rfn)?"), ("ofl-1.1", "ofl 1 1(?: rfn| no rfn)?"),
    ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0", "cc0(?: 1 0)?"), ("cc-pddc", "cc pddc"),
    ("cc-by", "cc by (?:1 0|2 [05]|3 0)(?: [a-z]{2,3})?"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa", "cc by sa (?:1 0|2 [015]|3 0)(?: [a-z]{2,3})?"), ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-nc", "cc by nc (?:1 0|2 [05]|3 0)(?: [a-z]{2,3})?"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd", "cc by nd (?:1 0|2 [05]|3 0)(?: [a-z]{2,3})?"), ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa (?:1 0|2 [05]|3 0)(?: [a-z]{2,3})?"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd (?:1 0|2 [05]|3 0)(?: [a-z]{2,3})?"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
)

# A further id of an expression of ids: label, expression, keyword.
JOINED = (
    ("mit", "apache 2 0 (?:or|and) mit", "apache"), ("mit", "bsd [23] clause (?:or|and) mit", "clause"), ("mit", "gpl [23] 0(?: only| or later)? (?:or|and) mit", "gpl"),
    ("apache-2.0", "(?:or|and) apache 2 0(?: with llvm exception)?", "apache"), ("bsd-2-clause", "(?:or|and) bsd 2 clause", "clause"),
    ("bsd-3-clause", "(?:or|and) bsd 3 clause", "clause"), ("gpl-2.0", "(?:or|and) gpl 2 0(?: only| or later)?(?: with [^ ]+ exception(?: [0-9] [0-9])?)?", "gpl"),
    ("gpl-3.0", "(?:or|and) gpl 3 0(?: only| or later)?(?: with [^ ]+ exception(?: [0-9] [0-9])?)?", "gpl"), ("lgpl-2.0", "(?:or|and) lgpl 2 0(?: only| or later)?", "lgpl"),
    ("lgpl-2.1", "(?:or|and) lgpl 2 1(?: only| or later)?", "lgpl"), ("lgpl-3.0", "(?:or|and) lgpl 3 0(?: only| or later)?", "lgpl"),
    ("agpl-3.0", "(?:or|and) agpl 3 0(?: only| or later)?", "agpl"), ("mpl-1.1", "(?:or|and) mpl 1 1", "mpl"), ("mpl-2.0", "(?:or|and) mpl 2 0", "mpl"),
    ("epl-1.0", "(?:or|and) epl 1 0", "epl"), ("epl-2.0", "(?:or|and) epl 2 0", "epl"), ("cddl-1.0", "(?:or|and) cddl 1 0", "cddl"), ("boost-1.0", "(?:or|and) bsl 1 0", "bsl"),
    ("cc0", "(?:or|and) cc0 1 0", "cc0"), ("ofl-1.1", "(?:or|and) ofl 1 1", "ofl"),
)

# Short names in prose and forms with optional words: label, expression, keyword, confidence.
PUBLISHED = "(?: as published by the free software foundation)?(?: either)?"
PROSE = (
    ("agpl-3.0", f"(?:gnu )?agpl ?{_version(3)}@later", "agpl", 0.85), ("agpl-3.0", f"(?:gnu )?affero (?:general public license|gpl) {_version(3)}@later", "affero", 0.85),
    ("agpl-3.0", "gnu agpl", "agpl", 0.75), ("agpl-1.0", "affero general public license (?:version |v )?1(?: 0)?", "affero", 0.85),
    ("lgpl-2.0", f"(?:gnu )?lgpl ?{_version(2)}@later", "lgpl", 0.85), ("lgpl-2.1", f"(?:gnu )?lgpl ?{_version(2, '1', True)}@later", "lgpl", 0.85),
    ("lgpl-3.0", f"(?:gnu )?lgpl ?{_version(3)}@later", "lgpl", 0.85), ("lgpl", "(?:gnu )?lgpl", "lgpl", 0.75), ("lgpl", "(?:gnu )?lesser gpl", "lesser", 0.75),
    ("lgpl-2.0", f"(?:gnu )?library (?:general public license|gpl) {_version(2)}@later", "library", 0.85),
    ("lgpl-2.1", f"(?:gnu )?lesser (?:general public license|gpl) {_version(2, '1', True)}@later", "lesser", 0.85),
    ("lgpl-3.0", f"(?:gnu )?lesser (?:general public license|gpl) {_version(3)}@later", "lesser", 0.85),
    ("gpl-1.0", "(?:gnu )?gpl ?(?:version |v |v)1(?: 0)?@later", "gpl", 0.85),
    ("gpl-2.0", f"(?:gnu )?(?:gpl ?{_version(2)})@later", "gpl", 0.85), ("gpl-3.0", f"(?:gnu )?(?:gpl ?{_version(3)})@later", "gpl", 0.85),
    ("gpl-2.0", f"gnu general public license{PUBLISHED} (?:version |v)2(?: 0)?(?: of the license)?@later", "general", 0.9),
    ("gpl-3.0", f"gnu general public license{PUBLISHED} (?:version |v)3(?: 0)?(?: of the license)?@later", "general", 0.9),
    ("lgpl-2.0", f"gnu library general public license{PUBLISHED} (?:version |v)2(?: 0)?(?: of the license)?@later", "library", 0.9),
    ("lgpl-2.1", f"gnu lesser general public license{PUBLISHED} (?:version |v)2 1(?: of the license)?@later", "lesser", 0.9),
    ("lgpl-3.0", f"gnu lesser general public license{PUBLISHED} (?:version |v)3(?: 0)?(?: of the license)?@later", "lesser", 0.9),
    ("agpl-3.0", f"gnu affero general public license{PUBLISHED} (?:version |v)3(?: 0)?(?: of the license)?@later", "affero", 0.9),
    ("gfdl", "(?:gnu )?fdl (?:version |v)?1 [1-3]@later", "fdl", 0.85),
    ("gfdl", "gnu free documentation license (?:version |v)?1 [1-3]@later", "documentation", 0.9),
    ("apache-2.0", "apache (?:software )?license (?:version |v)2(?: 0)?", "apache", 0.9), ("apache-2.0", "apache v?2(?: 0)? licen[cs]ed?", "apache", 0.85),
    ("apache-2.0", "asl ?(?:version |v)?2 0", "asl", 0.75), ("apache-1.1", "apache (?:software )?license (?:version |v)1 1", "apache", 0.9),
    ("apache-1.0", "apache (?:software )?license (?:version |v)1 0", "apache", 0.9),
    ("0bsd", "(?:0|zero) clause bsd(?: licen[cs]e)?", "clause", 0.85), ("bsd-2-clause", "(?:2|two) clause bsd(?: licen[cs]e)?", "clause", 0.85),
    ("bsd-3-clause", "(?:3|three) clause bsd(?: licen[cs]e)?", "clause", 0.85), ("bsd-4-clause", "(?:4|four) clause bsd(?: licen[cs]e)?", "clause", 0.85),
    ("bsd-2-clause", "bsd (?:2|two) clause(?: licen[cs]e)?", "clause", 0.85), ("bsd-3-clause", "bsd (?:3|three) clause(?: licen[cs]e)?", "clause", 0.85),
    ("bsd-2-clause", "freebsd licen[cs]e", "freebsd", 0.85), ("bsd-4-clause", "(?:original|old) bsd licen[cs]e", "bsd", 0.85), ("bsd", "bsd (?:style|type|like) licen[cs]e", "bsd", 0.75),
    ("mit", "(?:mit|expat) licen[cs]ed?", "licen", 0.75), ("mit", "(?:mit|expat) x11 licen[cs]e", "x11", 0.85), ("mit-0", "mit (?:0|zero)(?: licen[cs]e)?", "mit", 0.75), ("mit", "mit (?:style|type) licen[cs]e", "mit", 0.75),
    ("x11", "x11 licen[cs]e", "x11", 0.8), ("isc", "(?:internet systems consortium )?isc licen[cs]e", "isc", 0.8),
    ("mpl-1.0", "mpl ?(?:version |v)?1 0", "mpl", 0.85), ("mpl-1.1", "mpl ?(?:version |v)?1 1", "mpl", 0.85), ("mpl-1.1", "mozilla public license (?:version |v)?1 1", "mozilla", 0.9),
    ("mpl-2.0", "mpl ?(?:version |v)?2(?: 0)?", "mpl", 0.85), ("mpl-2.0", "mozilla public license (?:version |v)2(?: 0)?", "mozilla", 0.9),
    ("npl", "netscape public license(?: (?:version |v)?1 [01])?", "netscape", 0.85),
    ("epl-1.0", "eclipse public license (?:version |v) ?1 0", "eclipse", 0.9), ("epl-2.0", "eclipse public license (?:version |v) ?2 0", "eclipse", 0.9), ("epl-2.0", "epl ?(?:version |v)?2 0", "epl", 0.8),
    ("epl-1.0", "epl ?(?:version |v)?1 0", "epl", 0.8), ("cpl-1.0", "common public license(?: (?:version |v)?1 0)?", "common", 0.85), ("ipl-1.0", "ibm public license(?: (?:version |v)?1 0)?", "ibm", 0.85),
    ("cddl-1.0", "cddl ?(?:version |v)?1 0", "cddl", 0.85), ("cddl-1.1", "cddl ?(?:version |v)?1 1", "cddl", 0.85), ("cddl", "cddl(?: licen[cs]ed?)?", "cddl", 0.75),
    ("cddl-1.0", "common development and distribution license (?:cddl )?(?:version |v)?1 0", "development", 0.9), ("cpal-1.0", "common public attribution license(?: (?:version |v)?1 0)?", "attribution", 0.85),
    ("eupl", "(?:european union public licen[cs]e )?eupl (?:version |v ?)?1 [0-2]", "eupl", 0.85), ("cecill", "cecill(?: [bc])?(?: (?:version |v)?[12](?: [01])?)? licen[cs]e", "cecill", 0.85),
    ("boost-1.0", "boost software license (?:version |v)?1 0", "boost", 0.9), ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", 0.85), ("libpng", "libpng licen[cs]e", "libpng", 0.85),
    ("artistic-2.0", "artistic licen[cs]e (?:version |v)?2(?: 0)?", "artistic", 0.9), ("artistic", "(?:perl|clarified) artistic licen[cs]e", "artistic", 0.85), ("artistic", "same terms as perl(?: itself)?", "perl", 0.85),
    ("python-2.0", "(?:psf )?python(?: software foundation)? licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "python", 0.85), ("ruby", "ruby(?: s)? licen[cs]e", "ruby", 0.8),
    ("php", "php licen[cs]e(?: (?:version |v)?3 01?)?", "php", 0.85), ("zpl", "zope public licen[cs]e(?: (?:version |v)?[12] [01])?", "zope", 0.85), ("tcl", "tcl(?: tk)? licen[cs]e", "tcl", 0.8),
    ("vim", "vim licen[cs]e", "vim", 0.85), ("curl", "curl licen[cs]e", "curl", 0.85), ("openssl", "openssl(?: ssleay)? licen[cs]e", "openssl", 0.85), ("postgresql", "postgresql licen[cs]e", "postgresql", 0.85),
    ("sleepycat", "sleepycat(?: public)? licen[cs]e", "sleepycat", 0.85), ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa", 0.85), ("w3c", "w3c software(?: notice and)? licen[cs]e", "w3c", 0.85),
    ("afl", "academic free licen[cs]e(?: (?:version |v)?[123] [0-2])?", "academic", 0.85), ("osl", "open software licen[cs]e(?: (?:version |v)?[123] [01])?", "software", 0.85),
    ("ecl", "educational community licen[cs]e(?: (?:version |v)?[12] 0)?", "educational", 0.85), ("ms-pl", "microsoft public licen[cs]e", "microsoft", 0.85), ("ms-rl", "microsoft reciprocal licen[cs]e", "reciprocal", 0.85),
    ("lppl", "latex project public licen[cs]e(?: (?:version |v)?1 [0-3][ac]?)?", "latex", 0.85), ("qpl-1.0", "q public licen[cs]e(?: (?:version |v)?1 0)?", "licen", 0.85),
    ("sspl-1.0", "server side public licen[cs]e(?: (?:version |v)?1)?", "server", 0.85), ("busl-1.1", "business source licen[cs]e(?: (?:version |v)?1 1)?", "business", 0.85), ("elastic-2.0", "elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "elastic", 0.85),
    ("upl-1.0", "universal permissive licen[cs]e(?: (?:version |v)?1 0)?", "permissive", 0.85), ("mulan-psl", "mulan (?:permissive software licen[cs]e|psl)(?: (?:version |v)?[12])?", "mulan", 0.85),
    ("beerware", "beer ?ware licen[cs]e", "beer", 0.85), ("unlicense", "(?:the )?unlicense", "unlicense", 0.75), ("wtfpl", "wtfpl", "wtfpl", 0.75),
    ("ofl-1.1", "sil open font license (?:version |v)?1 1", "font", 0.9), ("ofl-1.1", "(?:sil )?ofl ?(?:version |v)?1 1", "ofl", 0.85),
    ("odbl-1.0", "(?:odc )?open database licen[cs]e(?: odbl)?(?: (?:version |v)?1 0)?", "database", 0.85), ("odbl-1.0", "odbl", "odbl", 0.75), ("odc-by-1.0", "open data commons attribution licen[cs]e", "commons", 0.85),
    ("pddl-1.0", "(?:open data commons )?public domain dedication and licen[cs]e", "dedication", 0.85), ("ogl-uk", "open government licen[cs]e(?: (?:version |v)?[123](?: 0)?)?", "government", 0.85),
    ("cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", "cc0", 0.85),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike 4 0(?: international)?", "creative", 0.9), ("cc-by-sa-3.0", "creative commons attribution share ?alike 3 0(?: unported)?", "creative", 0.9),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?", "creative", 0.9),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?", "creative", 0.9),
    ("cc-by-nc", "creative commons attribution non ?commercial [1-4] [05](?: international| unported)?", "creative", 0.9),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?", "creative", 0.9),
    ("cc-by-4.0", "creative commons attribution 4 0(?: international)?", "creative", 0.9), ("cc-by-3.0", "creative commons attribution 3 0(?: unported)?", "creative", 0.9),
)

# Texts of common licenses, with bounded gaps: label, expression, keyword, confidence.
TEXTS = (
    ("mit", "permission is hereby granted free of charge(?: to any person(?: obtaining a copy)?(?: [^ ]+){0,12}? without restriction)?", "hereby", 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 0.95),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: [^ ]+){0,8}? is hereby granted", "hereby", 0.95),
    ("bsd", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", "redistribution", 0.9),
    ("bsd-3-clause", "redistribution and use in source and binary forms(?: [^ ]+){0,120}? neither the names? of(?: [^ ]+){1,16}? nor the names of", "neither", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "advertising", 0.95),
    ("apache-2.0", "licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license", "compliance", 1.0),
    ("apache-2.0", "licensed to the apache software foundation(?: asf)? under one or more contributor license agreements", "contributor", 0.9),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 0.95),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute", 0.95),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute", 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation", 1.0),
    ("mpl-2.0", "subject to the terms of the mozilla public license(?: v| version)? ?v?2 0", "mozilla", 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license(?: version)? 1 1", "mozilla", 1.0),
    ("epl-2.0", "made available under the terms of the eclipse public license(?: v| version)? ?v?2 0", "eclipse", 1.0),
    ("epl-1.0", "made available under the terms of the eclipse public license(?: v| version)? ?v?1 0", "eclipse", 1.0),
    ("cddl", "subject to the terms of the common development and distribution license", "development", 0.95),
    ("zlib", "altered source versions must be plainly marked as such(?: [^ ]+){0,8}? misrepresented", "altered", 0.95),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.95),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost", 1.0),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying", 1.0),
    ("wtfpl", "do what the fuck you want to public license", "want", 0.95),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "whatever", 0.95),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "font", 1.0),
    ("ncsa", "permission is hereby granted free of charge(?: [^ ]+){0,20}? to deal with the software without restriction", "hereby", 0.95),
    ("cc0", "has (?:dedicated the work to the public domain|waived all copyright)(?: [^ ]+){0,30}? worldwide", "worldwide", 0.9),
    ("cc-by", "this work is licensed under a creative commons attribution(?: [0-9] [0-9])? (?:international |unported )?license", "creative", 0.95),
    ("json", "the software shall be used for good not evil", "evil", 0.95),
)

# Between words; letters of either case belong to words here.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Marks the words at which a match begins; no word holds it.
MARK = "\x01"
# Detections that suppression looks at in one fold.
FOLD = 512


@dataclass(frozen=True)
class Rule:
    """One signature: ``pattern`` spans exactly ``n_words`` words, or those it matches if 0, and holds ``keyword``."""

    label: str
    pattern: str
    keyword: str
    n_words: int
    priority: int
    confidence: float


def _variants(pattern: str) -> list[str]:
    """Without groups of words that are optional or of unlike lengths: one fixed-length pattern each."""
    found, left = [], pattern.find("(?:")
    if left < 0:
        return [pattern]
    right = pattern.index(")", left)
    choices = pattern[left + 3:right].split("|")
    tail = pattern[right + 1:]
    if tail.startswith("?"):
        choices, tail = [*choices, ""], tail[1:]
    for choice in choices:
        found += _variants(pattern[:left] + choice + tail)
    return found


def signature_rules() -> list[Rule]:
    """All names with all leads, most specific priority first."""
    rules = [
        Rule(label, text, keyword, text.count(" ") + 1, priority, confidence)
        for lead, priority, confidence in LEADS
        for label, name, keyword in NAMES
        for text in _variants(f"{lead} {name}".strip())
    ]
    return sorted(set(rules), key=lambda r: (r.priority, -r.n_words, r.pattern, r.label))


def expression_rules() -> list[Rule]:
    """Ids, short names and license texts; they take the interval that they match."""
    rules = [Rule(label, f"{TAG} {text}", "licen", 0, 0, 1.0) for label, text in IDS]
    rules += [Rule(label, text, keyword, 0, 0, 0.95) for label, text, keyword in JOINED]
    rules += [Rule(label, text.replace("@later", LATER), keyword, 0, 1, confidence) for label, text, keyword, confidence in PROSE]
    rules += [Rule(label, text, keyword, 0, 0, confidence) for label, text, keyword, confidence in TEXTS]
    return sorted(set(rules), key=lambda r: (r.priority, -r.confidence, r.pattern, r.label))


def base_rules() -> list[Rule]:
    return [Rule(label, phrase, phrase.split()[0], phrase.count(" ") + 1, 0, 0.75) for phrase, label in BASE_PHRASES]


def _literal(rules: list[Rule]) -> Column:
    """The rules as one constant, read from text: a column per field would take longer to build than a scan takes."""
    rows = [{"rank": k, "label": r.label, "keyword": r.keyword, "regex": f" (?=({r.pattern}) )", "n": r.n_words, "confidence": r.confidence}
            for k, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rank:int,label:string,keyword:string,regex:string,n:int,confidence:double>>")


def _places(norm: Column, rule: Column) -> Column:
    """Words before each place of the expression, with the words it matches there.

    A mark is put before every match and the marked words are numbered: the work is in
    proportion to the text, however many places there are.
    """
    spaces = lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))
    at = lambda m: F.filter(F.transform(F.split(m, " "), lambda w, i: F.when(w.startswith(MARK), i - 1)), lambda i: i.isNotNull())
    # The places and the matches of an expression come in the same order.
    matched = F.transform(F.regexp_extract_all(norm, rule["regex"], F.lit(1)), lambda m: spaces(m) + 1)
    widths = lambda starts: F.when(rule["n"] == 0, matched).otherwise(F.array_repeat(rule["n"], F.size(starts)))
    zipped = lambda starts: F.arrays_zip(starts.alias("s"), widths(starts).alias("n"))
    marked = F.transform(F.array(F.regexp_replace(norm, rule["regex"], F.lit(f" {MARK}"))), lambda m: F.when(
        F.contains(m, F.lit(MARK)), at(m)).otherwise(F.array().cast("array<int>")))
    return F.flatten(F.transform(marked, lambda starts: F.when(F.size(starts) > 0, zipped(starts)).otherwise(
        F.array().cast("array<struct<s:int,n:int>>"))))


def _detect(norm: Column, rules: list[Rule]) -> Column:
    """All detections of a text, in the order in which suppression looks at them."""
    # Each keyword is looked for once, not once per rule.
    present = F.filter(F.from_json(F.lit(json.dumps(sorted({r.keyword for r in rules}))), "array<string>"), lambda k: F.contains(norm, k))
    tried = F.flatten(F.transform(F.array(present), lambda words: F.when(F.size(words) > 0, F.filter(
        _literal(rules), lambda r: F.array_contains(words, r["keyword"]))).otherwise(F.slice(_literal(rules), 1, 0))))
    found = F.transform(tried, lambda r: F.transform(_places(norm, r), lambda x: F.struct(
        x["s"].alias("start"), (-(x["s"] + x["n"])).alias("minus_end"), r["rank"].alias("rank"),
        r["label"].alias("label"), r["confidence"].alias("confidence"),
    )))
    return F.array_sort(F.flatten(found))


def _unsuppressed(detections: Column) -> Column:
    """Without those inside an earlier one: sorted by start, then longest first, only the furthest end counts.

    Lists are extended by copying them, so they are folded in stretches of ``FOLD``.
    """
    kind = "array<struct<start:int,minus_end:int,rank:int,label:string,confidence:double>>"

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        return F.when(end <= acc["end"], acc).otherwise(
            F.struct(end.alias("end"), F.concat(acc["kept"], F.array(d)).alias("kept")))

    def stretch(acc: Column, part: Column) -> Column:
        nothing = F.struct(acc["end"].alias("end"), F.array().cast(kind).alias("kept"))
        return F.aggregate(part, nothing, step, lambda done: F.struct(
            done["end"].alias("end"), F.concat(acc["kept"], F.array(done["kept"])).alias("kept")))

    last = F.floor((F.greatest(F.size(detections), F.lit(1)) - 1) / FOLD).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(detections, k * FOLD + 1, FOLD))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind}>").alias("kept"))
    return F.when(detections.isNotNull(), F.flatten(F.aggregate(parts, start, stretch, lambda acc: acc["kept"])))


def _always(pattern: str) -> str:
    """What every match of an expression holds: the text outside all groups."""
    while "(?:" in pattern:
        pattern = re.sub(r"\(\?:[^()]*\)(?:\?|\{[0-9,]+\}\??)?", "\n", pattern)
    return pattern


def gate_words(rules: list[Rule]) -> list[str]:
    """Words of which every match of any rule holds one; those that contain another are left out."""
    words = sorted({"licen" if "licen" in _always(r.pattern) else r.keyword for r in rules}, key=lambda w: (len(w), w))
    return [w for k, w in enumerate(words) if not any(shorter in w for shorter in words[:k])]


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``base`` and ``detections`` (arrays of intervals with labels)."""
    rules = [*signature_rules(), *expression_rules()] if rules is None else rules
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The gate may let too much through, never too little: each rule holds one of its words.
    gate = F.lit(False)
    for word in gate_words([*base_rules(), *rules]):
        gate = gate | F.contains(F.lower("text"), F.lit(word))
    lowered = F.translate(F.regexp_replace("text", BREAK, " "), upper, lower)
    norm = F.when(gate, F.concat(F.lit(" "), F.trim(lowered), F.lit(" ")))
    pieces = F.split("text", BREAK, -1)
    empty_ends = F.when(pieces[0] == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    rows = rows.select("id", (F.size(pieces) - empty_ends).cast("long").alias("n_words"), norm.alias("norm"))
    rows = rows.select(
        "id", "n_words", _detect(F.col("norm"), base_rules()).alias("base"), _detect(F.col("norm"), rules).alias("found"),
    )
    return rows.select("id", "n_words", "base", _unsuppressed(F.col("found")).alias("detections"))


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, joined labels and the highest confidence of every scanned row."""
    labels = lambda d: F.coalesce(F.transform(d, lambda x: x["label"]), F.array().cast("array<string>"))
    joined = lambda d: F.array_join(F.array_sort(F.array_distinct(d)), ",")
    place = F.transform("base", lambda x: x["start"].cast("long"))
    base, all_labels = labels(F.col("base")), F.concat(labels(F.col("base")), labels(F.col("detections")))
    confidence = lambda d: F.transform(d, lambda x: x["confidence"])
    strongest = F.greatest(F.array_max(confidence(F.col("base"))), F.array_max(confidence(F.col("detections"))))
    return scanned.select(
        F.col("id").alias("doc_id"), "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        joined(base).alias("base_labels"), joined(all_labels).alias("labels"),
        F.coalesce(strongest, F.lit(0.0)).alias("score"),
    )
