"""Fixed word lists used by the analyzers and the markup stripper."""

from __future__ import annotations

# The 33-word English stop list of the `standard` analyzer.
ENGLISH_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()

# Default stop words of the `porter` analyzer: closed-class English words.  The
# full published list of an IR toolkit is longer than a source file should hold,
# so it is a parameter: `get_analyzer("porter", stop_words=[...])`.
FUNCTION_WORDS = sorted(
    set(ENGLISH_STOP_WORDS)
    | set(
        (
            # pronouns and possessives
            "i me my mine myself we us our ours ourselves you your yours yourself "
            "yourselves he him his himself she her hers herself its itself them "
            "theirs themselves one who whom whose which what "
            # auxiliaries and modals
            "am were been being has have had having do does did doing done can "
            "could may might must shall should would "
            # determiners and quantifiers
            "those some any each every either neither all both few many more most "
            "much other another own same several "
            # prepositions
            "about above across after against along among around before behind "
            "below beneath beside besides between beyond down during except from "
            "inside near off onto out outside over per since through throughout "
            "till toward towards under until up upon via within without "
            # conjunctions and adverbs
            "nor so yet because although though while whereas unless than when "
            "whenever where wherever whether why how here again also just only "
            "too very however therefore thus hence else"
        ).split()
    )
)

# Elements that start a new block, so words on both sides of their
# tags are separate words.  Tags of all other elements vanish without a gap.
BLOCK_ELEMENTS = (
    "html head body frameset script noscript style meta link title frame noframes "
    "section nav aside hgroup header footer p h1 h2 h3 h4 h5 h6 ul ol pre div "
    "blockquote hr address figure figcaption form fieldset ins del s dl dt dd li "
    "table caption thead tfoot tbody colgroup col tr th td video audio canvas "
    "details menu plaintext article main br"
).split()
