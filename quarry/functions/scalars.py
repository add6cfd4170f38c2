"""The scalar functions of the expression language beyond its standard ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soundex(text: Column) -> Column:
    """American Soundex of the letters of *text*; '0000' without a leading ASCII letter."""
    letters = F.regexp_replace(text, r"\P{L}", "")
    # other letters part equal codes as vowels do
    plain = F.regexp_replace(letters, r"[^A-Za-z]", "A")
    return F.when(letters.rlike("^[A-Za-z]"), F.soundex(plain)).otherwise(F.lit("0000"))


def ngrams(text: Column, n: Column) -> Column:
    """The *n*-grams of characters; none if n < 1 or the text is shorter."""
    size = F.char_length(text)
    n = n.cast("int")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.when((n > 0) & (n <= size), grams).otherwise(F.array().cast("array<string>"))


def ngram_similarity(a: Column, b: Column, n: Column) -> Column:
    """Jaccard likeness of the n-gram sets; 1 if both are empty, 0 if one is."""
    both = F.struct(ngrams(a, n).alias("x"), ngrams(b, n).alias("y"))
    return F.transform(
        F.array(both),
        lambda g: F.when((F.size(g["x"]) == 0) & (F.size(g["y"]) == 0), F.lit(1.0)).otherwise(
            F.size(F.array_intersect(g["x"], g["y"])).cast("double") / F.size(F.array_union(g["x"], g["y"]))
        ),
    )[0]


def point_in_polygon(lat: Column, lon: Column, polygon: Column) -> Column:
    """Even-odd ray casting over [lat, lon, lat, lon, ...]; false with fewer than three corners or an odd length."""
    corners = (F.size(polygon) / 2).cast("int")

    def crosses(i: Column) -> Column:
        j = F.pmod(i + corners - 1, corners)
        y, x, y0, x0 = (F.get(polygon, k) for k in (i * 2, i * 2 + 1, j * 2, j * 2 + 1))
        return ((y > lat) != (y0 > lat)) & (lon < F.try_divide((x0 - x) * (lat - y), y0 - y) + x)

    odd = F.size(F.filter(F.sequence(F.lit(0), F.greatest(corners - 1, F.lit(0))), crosses)) % 2 == 1
    return F.when((F.size(polygon) < 6) | (F.size(polygon) % 2 == 1), F.lit(False)).otherwise(odd)


def similar_hash(phash: Column, reference: Column, threshold: Column) -> Column:
    """Whether two 16-digit hexadecimal image hashes differ in at most (1 - threshold) * 64 bits; false if either is no hash."""
    bits = lambda h: F.conv(F.when(F.rlike(h, F.lit("^(0x)?[0-9a-fA-F]{1,16}$")), F.regexp_replace(h, "^0x", "")), 16, -10).cast("bigint")
    allowed = ((1 - F.least(F.greatest(threshold, F.lit(0.0)), F.lit(1.0))) * 64).cast("int")
    return F.coalesce(F.bit_count(bits(phash).bitwiseXOR(bits(reference))) <= allowed, F.lit(False))


# Our own patterns for the documented categories of secrets, in the syntax that Java and RE2 share.
SECRETS = {
    "aws_access_key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "aws_secret_key": r"(?i)aws.{0,20}(secret|private).{0,20}['\"][0-9a-z/+]{40}['\"]",
    "card_number": r"\b(4[0-9]{3}|5[1-5][0-9]{2}|6011)[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "github_token": r"\b(ghp|gho|ghu|ghs|ghr)_[0-9A-Za-z]{36}\b|\bgithub_pat_[0-9A-Za-z_]{22,}",
    "gitlab_token": r"\bglpat-[0-9A-Za-z_-]{20}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "npm_token": r"\bnpm_[0-9A-Za-z]{36}\b",
    "openai_key": r"\bsk-[0-9A-Za-z_-]{20,}",
    "password_assignment": r"(?i)\b(password|passwd|pwd|secret|token|api_?key)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]",
    "pem_private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"\b[sr]k_(live|test)_[0-9A-Za-z]{16,}",
}


#: What a text in lower case must hold for a category's pattern to be worth a try.
_HINTS = {
    "aws_access_key": ["akia", "asia"],
    "aws_secret_key": ["aws"],
    "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"],
    "gitlab_token": ["glpat-"],
    "google_api_key": ["aiza"],
    "jwt": ["eyj"],
    "npm_token": ["npm_"],
    "openai_key": ["sk-"],
    "password_assignment": ["passw", "pwd", "secret", "token", "api"],
    "pem_private_key": ["-----begin "],
    "slack_token": ["xox"],
    "stripe_key": ["k_live_", "k_test_"],
}


def secret_kinds(text: Column) -> Column:
    """The categories of secrets in *text*, sorted; patterns are tried only where their fixed parts occur."""

    def kinds(low: Column) -> Column:
        found = []
        for kind, pattern in sorted(SECRETS.items()):
            test = F.rlike(text, F.lit(pattern))
            if kind in _HINTS:
                hint = low.contains(_HINTS[kind][0])
                for word in _HINTS[kind][1:]:
                    hint = hint | low.contains(word)
                test = hint & test
            found.append(F.when(test, F.lit(kind)))
        return F.array_compact(F.array(*found))

    return F.transform(F.array(F.lower(text)), kinds)[0]


def license_id(body: Column) -> Column:
    """The SPDX name of a licence text, by the phrases it holds; '' if unknown."""
    low = F.lower(body)
    has = lambda *words: [low.contains(w) for w in words]
    # Phrases in order; the first that all occur decides.
    rules = [
        ("Apache-2.0", ["apache license", "version 2.0"]),
        ("AGPL-3.0", ["gnu affero general public license"]),
        ("LGPL-3.0", ["gnu lesser general public license", "version 3"]),
        ("LGPL-2.1", ["gnu lesser general public license", "version 2.1"]),
        ("LGPL-2.1", ["gnu lesser general public license", "version 2,"]),
        ("GPL-3.0", ["gnu general public license", "version 3"]),
        ("GPL-2.0", ["gnu general public license", "version 2"]),
        ("GPL-2.0", ["gnu general public license", "v2"]),
        ("MPL-2.0", ["mozilla public license", "2.0"]),
        ("BSL-1.0", ["boost software license"]),
        ("CC0-1.0", ["creative commons", "cc0"]),
        ("Unlicense", ["this is free and unencumbered software released into the public domain"]),
        ("Unlicense", ["the unlicense"]),
        ("ISC", ["permission to use, copy, modify, and/or distribute this software for any purpose"]),
        ("BSD-3-Clause", ["redistribution and use in source and binary forms", "neither the name"]),
        ("BSD-2-Clause", ["redistribution and use in source and binary forms"]),
        ("MIT", ["permission is hereby granted, free of charge"]),
    ]
    out = None
    for name, words in rules:
        tests = has(*words)
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.coalesce(out, F.lit(""))
