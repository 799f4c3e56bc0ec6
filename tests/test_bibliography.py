"""Lists of references and numbers of subsections against written-out answers."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quire.functions import bibliography as B
from quire.functions import sentences as S

from .test_pages import each

BOOK = "Marlow, Ines. 1998. Walking the River. Cambridge: Cambridge University Press."
PAPER = 'Óbrien-Tate, Kim, and Paul R. Dunn. 2004. "On Tides." Journal of Water 12(3):45–67.'
LINKED = "Quist, B., & Rao, T. M. (2021). Slow rivers. River Notes, 7, 11. https://doi.org/10.1234/rn.7"
NUMBERED = ["1. A. B. Marlow et al., Rivers of the north. Hydrol. 12, 34–56 (2001). doi: 10.1234/h.12; pmid: 11223344", "2. K. Dunn, P. Rao, Lakes. Limnol. 3, 1–9 (2003). doi: 10.1234/l.3"]
PHYSICS = ["[7] Marlow A B and Dunn K 1991 Waves in channels Phys. Fluid. Lett. 20 145–9", "[8] Rao T 1970 Numbers (Oslo: Berg) pp 20–31"]
#: What a column before has left of an entry, then a numbered one.
REST = ["measured in small lakes. Limnol. Rep. 9, 145 (2019). doi: 10.1234/lr.9", "20. G. Dunn et al., More lakes. Limnol. Rep. 11, 15 (2020)."]


@pytest.mark.parametrize(
    "want",
    [
        [BOOK],
        [PAPER],
        [LINKED],
        [BOOK, PAPER, BOOK],
        [LINKED, PAPER],
        [LINKED, "T.M. and E.J. Ashby (1997) On Banks. Technical Report 61, Mill Foundation."],
        NUMBERED,
        PHYSICS,
        REST,
        ["of rivers that freeze in winter and do not in summer. Clin Water 1998;44(1):61–7."],
        ["MARLOW, A.E & P. DUNN (2002), Rivers. In: K. Rao, ed., Water, Oslo: Berg, pp. 20–31."],
        ["Ines Marlow. 2011. On floods and the people who wait for them in the south. Pp. 25–76 in Floods."],
        ["O’Dunn, James. 1980. Wells of the plain and other ones. Water 47 (November): 387–406."],
        ["[4] Marlow A E and Dunn D R 1977 The dry river J. Phys. Water. 81 1564–70"],
        ["Marlow, I. The river is back. Morning News (2024 May 2)"],
        ["Bor, Jacob, Atheen S. Venka, David R. Will, and Alex C. Tsai. 2018. Flows. The Water 392(10144):302–10, 392(10):30–31."],
    ],
)
def test_entries(spark, want):
    assert each(spark, B.entries, [" ".join(want)]) == [want]
    assert each(spark, S.sentences, [" ".join(want)]) == [want]


@pytest.mark.parametrize(
    "text",
    [
        "Work by Marlow et al. (2003) shows that rivers freeze, although Dunn (2001) found none that did.",
        "We thank J. Marlow, K. Dunn and all at the mill for comments. The grant was 2017–0123.",
        "Ines Kim Marlow, Paul R. Dunn, Tara Rao, Elias Farr, Antoine Dara",
        "Marlow, I. (2023). This book asks how those who live at rivers see the weather of every day.",
        "Marlow, I. says that the level is 12:34 in this case, and Dunn (2021) says so for all of them.",
        "USGS, River Survey Office keeps gauges along every river; see https://rivers.example.org/gauges for them.",
        "See [12].",
        "1. Open rivers can affect publishing and reading by those who live there.",
        "[1] In 2008, rivers froze across the north. [2] In 2010, they froze in the south.",
        "[1] In the trial, Test. Cont. 100 200 rivers were seen. [2] In the next, Test. Cont. 50 60 rivers were.",
        "[1] The Dept. Agric. 2023 50-60 survey saw fewer. [2] The Dept. Energy. 2024 70-80 survey saw more.",
        "said at length elsewhere; see https://example.org/page. 20. Marlow J. (2023) One. Rivers, 13(12), 7082.",
        "The work has several steps. Step 12. Some more things apply. A copy is at 10.1234/later.",
        "[1] Take bus 4 (red): 50–60 people wait for it in the morning.",
        "",
        None,
    ],
)
def test_no_list(spark, text):
    assert each(spark, B.entries, [text]) == [None]
    assert each(spark, S.sentences, [text]) == each(spark, lambda c: S.cut(S._by_items(S.marked(c))), [text])


@pytest.mark.parametrize(
    "text, want",
    [
        ("4. Findings\n4.1. Schools of the Northern Rivers", ["4. Findings", "4.1. Schools of the Northern Rivers"]),
        ("Background\r\n  1.2.3. Third Level Title Here", ["Background", "1.2.3. Third Level Title Here"]),
        ("The value was 1.5. Robust Checks Follow", ["The value was 1.5.", "Robust Checks Follow"]),
        ("We use\n1.5. The new release adds telemetry.", ["We use 1.5.", "The new release adds telemetry."]),
        ("Then came\n1.1. After completing the test we moved on", ["Then came 1.1.", "After completing the test we moved on"]),
        ("Findings\n4. Some Heading Like Words", ["Findings 4.", "Some Heading Like Words"]),
        ("Findings\n4.1.", ["Findings 4.1."]),
        ("One\x02 two.\n\nThree", ["One two.", "Three"]),
    ],
)
def test_numbers_of_subsections(spark, text, want):
    assert each(spark, S.sentences, [text]) == [want]


def test_paragraphs_are_judged_apart(spark):
    text = f"A river froze. It did so twice.\n\n{BOOK} {PAPER}\n \nMore. End."
    assert each(spark, S.sentences, [text]) == [["A river froze.", "It did so twice.", BOOK, PAPER, "More.", "End."]]


def test_long_lists_and_long_words(spark):
    many = [f"{k % 900}. {'A. ' * 3}Marlow, Rivers. Hydrol. {k}, 34–56 (2001). doi: 10.1234/h.{k}" for k in range(1, 5001)]
    texts = [" ".join(many), "A. " * 50_000, "M" * 200_000 + ", A. 12", "Ma" * 100_000 + " " + "9" * 100_000, "Ab. " * 50_000 + "x"]
    begin = time.perf_counter()
    got = each(spark, B.entries, texts)
    assert got[0] == many and got[1:] == [None] * 4
    assert time.perf_counter() - begin < 60
