"""Signature rules for licence scans: what to look for, in which order of trust.

A rule is a regular expression over a text's words joined by single spaces (lower case,
so `GPL-3.0+` reads `gpl 3 0`), the words that must all stand in the text before it is
tried, a class and a relevance. The name tables below are hand-written; a rule for each
name, version and way of saying it is built from them.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

#: Classes, most trusted first: a detection goes if one of an earlier class holds it.
FULL_TEXT, STATEMENT, VERSIONED, NAMED, HINT = range(5)


class Rule(NamedTuple):
    label: str
    kind: int
    relevance: float
    pattern: str
    keywords: frozenset[str]


# The phrases and labels that the contract names.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_LICENSE = "licen[sc]es?"

# Licence families: label, ways to name it with their keywords, published versions.
_FAMILIES = (
    ("gpl", (("(?:gnu )?gpl", "gpl"), (f"(?:gnu )?general public {_LICENSE}", "general public")), "1.0 2.0 3.0"),
    ("lgpl", (("(?:gnu )?lgpl", "lgpl"), (f"(?:gnu )?lesser general public {_LICENSE}", "lesser general public"),
              (f"(?:gnu )?library general public {_LICENSE}", "library general public")), "2.0 2.1 3.0"),
    ("agpl", (("(?:gnu )?agpl", "agpl"), (f"(?:gnu )?affero general public {_LICENSE}", "affero general public")),
     "1.0 3.0"),
    ("gfdl", (("(?:gnu )?g?fdl", "fdl"), ("(?:gnu )?gfdl", "gfdl"),
              (f"(?:gnu )?free documentation {_LICENSE}", "free documentation")), "1.1 1.2 1.3"),
    ("apache", ((f"apache(?: software)? {_LICENSE}", "apache"), ("asl", "asl")), "1.0 1.1 2.0"),
    ("mpl", (("mpl", "mpl"), (f"mozilla public {_LICENSE}", "mozilla public")), "1.0 1.1 2.0"),
    ("epl", (("epl", "epl"), (f"eclipse public {_LICENSE}", "eclipse public")), "1.0 2.0"),
    ("cddl", (("cddl", "cddl"), (f"common development and distribution {_LICENSE}", "development distribution")),
     "1.0 1.1"),
    ("cpl", ((f"common public {_LICENSE}", "common public"),), "1.0"),
    ("eupl", (("eupl", "eupl"), (f"european union public {_LICENSE}", "european union public")), "1.0 1.1 1.2"),
    ("osl", ((f"open software {_LICENSE}", "open software"),), "1.0 1.1 2.0 2.1 3.0"),
    ("afl", ((f"academic free {_LICENSE}", "academic free"),), "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", ((f"artistic {_LICENSE}", "artistic"),), "1.0 2.0"),
    ("bsl", ((f"boost software {_LICENSE}", "boost software"),), "1.0"),
    ("busl", ((f"business source {_LICENSE}", "business source"), ("busl", "busl")), "1.0 1.1"),
    ("lppl", (("lppl", "lppl"), (f"latex project public {_LICENSE}", "latex project public")), "1.0 1.1 1.2 1.3"),
    ("ofl", ((f"(?:sil )?open font {_LICENSE}", "open font"), ("sil ofl", "sil ofl")), "1.0 1.1"),
    ("cecill", (("cecill", "cecill"),), "1.0 1.1 2.0 2.1"),
    ("zpl", ((f"zope public {_LICENSE}", "zope public"),), "1.1 2.0 2.1"),
    ("odbl", (("odbl", "odbl"), (f"open(?: data(?: commons)?)? database {_LICENSE}", "open database")), "1.0"),
    ("odc-by", ((f"open data commons attribution {_LICENSE}", "commons attribution"), ("odc by", "odc")), "1.0"),
    ("ecl", ((f"educational community {_LICENSE}", "educational community"),), "1.0 2.0"),
    ("php", ((f"php {_LICENSE}", "php"),), "3.0 3.01"),
    ("psf", ((f"python software foundation {_LICENSE}", "python software"), (f"psf {_LICENSE}", "psf")), "2.0"),
    ("qpl", ((f"q public {_LICENSE}", "q public"),), "1.0"),
    ("rpl", ((f"reciprocal public {_LICENSE}", "reciprocal public"),), "1.1 1.5"),
    ("sspl", (("sspl", "sspl"), (f"server side public {_LICENSE}", "server side public")), "1.0"),
    ("upl", ((f"universal permissive {_LICENSE}", "universal permissive"),), "1.0"),
    ("vsl", ((f"vovida software {_LICENSE}", "vovida"),), "1.0"),
    ("mulan-psl", ((f"mulan (?:psl|permissive software {_LICENSE})", "mulan"),), "1.0 2.0"),
)

# Licences without versions: label, ways to name it with their keywords.
_UNVERSIONED = (
    ("mit", ((f"mit {_LICENSE}", "mit"), (f"expat {_LICENSE}", "expat"), (f"x11 {_LICENSE}", "x11"))),
    ("bsd-2-clause", ((f"bsd 2 clause(?: {_LICENSE})?", "bsd 2 clause"), (f"2 clause bsd(?: {_LICENSE})?", "bsd 2 clause"),
                      (f"simplified bsd(?: {_LICENSE})?", "simplified bsd"), (f"freebsd {_LICENSE}", "freebsd"))),
    ("bsd-3-clause", ((f"bsd 3 clause(?: {_LICENSE})?", "bsd 3 clause"), (f"3 clause bsd(?: {_LICENSE})?", "bsd 3 clause"),
                      (f"(?:new|modified|revised) bsd(?: {_LICENSE})?", "bsd"))),
    ("bsd-4-clause", ((f"bsd 4 clause(?: {_LICENSE})?", "bsd 4 clause"), (f"4 clause bsd(?: {_LICENSE})?", "bsd 4 clause"),
                      (f"original bsd(?: {_LICENSE})?", "original bsd"))),
    ("bsd", ((f"bsd(?: style)? {_LICENSE}", "bsd"),)),
    ("isc", ((f"isc {_LICENSE}", "isc"),)),
    ("zlib", ((f"zlib(?: libpng)? {_LICENSE}", "zlib"),)),
    ("unlicense", (("(?:the )?unlicense", "unlicense"),)),
    ("wtfpl", (("wtfpl", "wtfpl"),)),
    ("beerware", (("beerware", "beerware"), (f"beer ware {_LICENSE}", "beer ware"))),
    ("cc0", (("cc0(?: 1 0)?", "cc0"), ("cc zero", "cc zero"))),
    ("public-domain", (("(?:in|into|to) the public domain", "public domain"),
                       ("public domain dedication", "public domain dedication"))),
    ("ms-pl", ((f"microsoft public {_LICENSE}", "microsoft public"), ("ms pl", "ms pl"))),
    ("ms-rl", ((f"microsoft reciprocal {_LICENSE}", "microsoft reciprocal"), ("ms rl", "ms rl"))),
    ("ncsa", ((f"(?:university of illinois )?ncsa open source {_LICENSE}", "ncsa open source"),)),
    ("openssl", ((f"openssl {_LICENSE}", "openssl"),)),
    ("vim", ((f"vim {_LICENSE}", "vim"),)),
    ("w3c", ((f"w3c software(?: and document)?(?: notice and)? {_LICENSE}", "w3c software"),)),
    ("curl", ((f"curl {_LICENSE}", "curl"),)),
    ("json", ((f"json {_LICENSE}", "json"),)),
    ("pddl", (("pddl", "pddl"), (f"public domain dedication and {_LICENSE}", "public domain dedication"))),
    ("proprietary", ((f"proprietary(?: software)? {_LICENSE}", "proprietary"),
                     ("proprietary and confidential", "proprietary confidential"))),
    ("commercial", ((f"commercial {_LICENSE}", "commercial"),)),
)

# Sentences of licence texts: label, sentence, keywords.
_TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission granted charge"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
     "software and to permit persons to whom the software is furnished to do so the software is provided",
     "permission granted sublicense"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution binary permitted"),
    ("bsd-3-clause", "neither the names? of [^ ]+(?: [^ ]+){0,12} nor the names of (?:its|the) contributors may be "
     "used to endorse or promote", "neither endorse promote"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display",
     "advertising materials"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee "
     "is hereby granted", "permission fee granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors "
     "be held liable", "express implied warranty"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license", "apache compliance"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     f"general public {_LICENSE}", "redistribute gnu general"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
     f"(?:lesser|library) general public {_LICENSE}", "redistribute gnu general"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy",
     "permission granted organization"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla subject"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "beer"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose "
     "(?:and )?without fee is hereby granted", "permission documentation fee"),
    ("no-redistribution", "(?:may|must) not be (?:reproduced|redistributed|copied)(?: [^ ]+){0,8} without"
     "(?: [^ ]+){0,4} permission", "permission without"),
)

# Creative Commons: short tokens and the words of the long name.
_CC = (("by", "attribution"), ("by nc", "attribution non ?commercial"),
       ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by sa", "attribution share ?alike"),
       ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
       ("by nc sa", "attribution non ?commercial share ?alike"))
_CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# Notices that say less than a licence: label, pattern, keywords.
_HINTS = (
    ("copyright", "copyright(?: c)?(?: 1[89][0-9][0-9]| 20[0-9][0-9])+", "copyright"),
    ("copyright", "copyright(?: c)? by", "copyright"),
    ("license-ref", f"see(?: the)? {_LICENSE} file", "see file"),
    ("license-ref", "see(?: the)? copying file", "copying file"),
    ("terms", "terms of (?:use|service)", "terms"),
    ("trademark", "registered trademarks?", "registered"),
    ("confidential", "strictly confidential", "strictly confidential"),
    ("confidential", "confidential and proprietary", "confidential proprietary"),
)


def version_pattern(version: str) -> str:
    """`2.0` as it reads in words: 2, v2, version 2, 2 0; never the start of 2 1."""
    major, minor = version.split(".")
    tail = f" {minor}" if minor != "0" else "(?: 0)?"
    return f"(?:version |ver |v |v)?{major}{tail}(?! [0-9])"


def _under(name: str) -> str:
    return (f"(?:(?:re)?licensed|released|distributed|available|published|provided) under(?: the)?"
            f"(?: terms of)?(?: the)?(?: version [0-9 ]+ of)?(?: the)? {name}")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def build_rules() -> list[Rule]:
    """All rules, most trusted first; earlier ones win between equal detections."""
    rules = [Rule(label, FULL_TEXT, 1.0, pattern, _words(keys)) for label, pattern, keys in _TEXTS]
    for label, names, versions in _FAMILIES:
        for name, keys in names:
            for version in versions.split():
                number = version_pattern(version)
                both = f"{name} {number}"
                exact = f"{label}-{version}"
                rules += [
                    Rule(f"{exact}-or-later", STATEMENT, 0.98,
                         f"{both} (?:or(?: at your option)?(?: any)? later(?: version)?|or newer|plus)",
                         _words(keys)),
                    Rule(f"{exact}-only", STATEMENT, 0.98, f"{both} only", _words(keys) | {"only"}),
                    Rule(exact, STATEMENT, 0.97, _under(both), _words(keys) | {"under"}),
                    Rule(exact, STATEMENT, 0.99, f"spdx license identifier {label.replace('-', ' ')} {number}",
                         frozenset(("spdx", "identifier"))),
                    Rule(exact, VERSIONED, 0.9, both, _words(keys))]
            rules += [Rule(label, STATEMENT, 0.8, _under(name), _words(keys) | {"under"}),
                      Rule(label, NAMED, 0.6, name, _words(keys))]
    for (short, long), version in itertools.product(_CC, _CC_VERSIONS.split()):
        exact = f"cc-{short.replace(' ', '-')}-{version}"
        number = version_pattern(version)
        rules += [
            Rule(exact, STATEMENT, 0.97, f"creativecommons org licenses {short} {version.replace('.', ' ')}",
                 frozenset(("creativecommons", "licenses"))),
            Rule(exact, STATEMENT, 0.97, _under(f"(?:cc {short}|creative commons {long})(?: {_LICENSE})? {number}"),
                 frozenset(("under",))),
            Rule(exact, VERSIONED, 0.9, f"cc {short} {number}", _words(f"cc {short}")),
            Rule(exact, VERSIONED, 0.9,
                 f"creative commons {long}(?: [0-9])?(?: international| unported| generic)?(?: public)?"
                 f"(?: {_LICENSE})? {number}", frozenset(("creative", "commons", "attribution")))]
    for short, long in _CC:
        label = f"cc-{short.replace(' ', '-')}"
        rules += [Rule(label, NAMED, 0.6, f"cc {short}", _words(f"cc {short}")),
                  Rule(label, NAMED, 0.6, f"creative commons {long}", frozenset(("creative", "commons", "attribution")))]
    for label, names in _UNVERSIONED:
        rules.append(Rule(label, STATEMENT, 0.99, f"spdx license identifier {label.replace('-', ' ')}",
                          frozenset(("spdx", "identifier"))))
        for name, keys in names:
            rules += [Rule(label, STATEMENT, 0.95, _under(name), _words(keys) | {"under"}),
                      Rule(label, NAMED, 0.7, name, _words(keys))]
    rules += [Rule(label, HINT, 0.3, pattern, _words(keys)) for label, pattern, keys in _HINTS]
    return sorted(rules, key=lambda r: r.kind)
