"""Metaphone as a plain column expression.

Follows the rules Lawrence Philips published in 1990. A letter's contribution
depends only on its neighbours, so every position is coded from a window of five
letters (one before, three after) by the first pattern that fits. No Python
worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Window pattern -> code. A blank stands for the word's edge; the letter coded is
# the second of the window.
WINDOW_CODES = {
    r"^.C(IA|H)": "X",
    r"^SC[EIY]": "",
    r"^.(C[EIY]|S(?!H|I[OA])|Z)": "S",
    r"^.(S(H|I[OA])|TI[OA])": "X",
    r"^(MB |.GH[^AEIOU]|.GN( |ED)|DG[EIY]|[CSPTG]H|.H[^AEIOU]|CK|.TCH|.[WY][^AEIOU])": "",
    r"^(.DG[EIY]|[^G]G[EIY])": "J",
    r"^.[CGKQ]": "K",
    r"^.TH": "0",
    r"^.[DT]": "T",
    r"^.(PH|V)": "F",
    r"^.X": "KS",
}


def metaphone(word: Column) -> Column:
    """Metaphone code of a word made of A-Z."""
    w = F.regexp_replace(F.upper(word), "^(A(?=E)|[GKP](?=N)|W(?=R))", "")
    w = F.regexp_replace(F.regexp_replace(w, "^X", "S"), "^WH", "W")
    # The one-element transform names the padded word once for all positions.
    return F.get(F.transform(F.array(F.concat(F.lit(" "), w, F.lit("   "))), _code_of), F.lit(0))


def _code_of(padded: Column) -> Column:
    letters = F.length(padded) - 4
    windows = F.when(
        letters > 0,
        F.transform(F.sequence(F.lit(1), letters), lambda i: F.substring(padded, i, F.lit(5))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(windows, _code_at), "")


def _code_at(window: Column) -> Column:
    # Of doubled letters only the last counts, except C; vowels count at the start only.
    letter = F.substring(window, 2, 1)
    chain = F.when(window.rlike(r"^.([ABD-Z])\1"), "").when(
        window.rlike("^.[AEIOU]"), F.when(window.startswith(" "), letter).otherwise("")
    )
    for pattern, code in WINDOW_CODES.items():
        chain = chain.when(window.rlike(pattern), code)
    # B, F, H, J, L, M, N, P, R, W and Y stand for themselves.
    return chain.when(window.rlike("^.[A-Z]"), letter).otherwise("")
