"""Fixed values of the document formats.

How lines of these documents are read rests on the patterns and words below;
they are part of the formats and must be exactly as they are for results to be
right.  Nothing here is computed.
"""

# Kinds of lines, by their start.
PART = r"^Part\s+\d+[A-Z]?\b"
CONDITION = r"^\d+[A-Z]?\.(?:\s|$)"
CLAUSE = r"^\d+[A-Z]?\.\d+[A-Z]?(?:\s|$)"
CAPITAL_LIMB = r"^\([A-Z]\)"
ROMAN_LIMB = r"^\((?!\))(?:x{0,3})(?:ix|iv|v?i{0,3})\)"
ALPHA_LIMB = r"^\([a-z]{1,2}\)"
DIGIT_LIMB = r"^\([0-9]+\)"
SUBTITLE = r"^[A-Z][A-Z0-9 &,\-]{8,60}$"

# Definitions: a quoted term and what follows it; a row of a glossary table.
DEFINITION = r"""(?i)^(?:"\s*[^"\n]{2,80}?\s*"|“\s*[^”\n]{2,80}?\s*”|'\s*[^'\n]{2,80}?\s*'|‘\s*[^’\n]{2,80}?\s*’)\s*\d*[A-Z]?\s*(?:means|has\s+the\s+meaning|shall\s+have|shall\s+mean|is\b|or\b|Condition\b|paragraph\b|Annex\b|Schedule\b|Appendix\b|Part\b|formula\b|term\b)"""
GLOSSARY_ROW = r"""(?i)^['"“‘]\s*[a-z0-9\s&-]{2,80}\s*['"”’]?\s*(?:Condition|paragraph|Annex|Schedule|Appendix|Part|means|has\s+the\s+meaning|shall\s+have|shall\s+mean|is\b).*?;"""

# Lines that are no text.
JUNK = (r"(?i)^DRAFT:", r"^\d+$", r"(?i)Note to Reader:", r"^\[.*\]$", r"(?i)^OFFICIAL\s*$")

# Contents lines: title, dot leader, page.
TOC_LINE = r"^(.*?)\s*\.*\s*(\d+)?\s*$"

# Questions that ask for an explanation.
EXPLANATION = (
    r"(?i)\b(explain|describe|outline|summari[sz]e|compare|contrast)\b",
    r"(?i)\bhow\s+(?:does|do|are|is|would|can)\b",
    r"(?i)\bwhy\b",
    r"(?i)\b(in practice|overall|walk me through|implications?|relationship)\b",
    r"(?i)\bwhat\s+(?:are|is)\b.*\b(work|process|effect|implication|requirements?)\b",
)

# Words that leave a sentence open at the end of a line; words of signature blocks.
FUNCTION_WORDS = "the and or of with for to in on at by a an is are".split()
SIGNATURE_WORDS = "signature signed name title date address attention".split()
