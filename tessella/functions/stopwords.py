"""English words that carry no meaning in a query; those with an apostrophe never equal a token."""

_BARE = """very any my only why they by below how few you about out most but against cannot not it ought what that at ours its
yours theirs hers this his is ourselves themselves does was has as our your nor for or their over after further other her under up
into to so too who no do down own on again in when then between been than an from whom him them am i all until both with through
such each which having during doing being of myself itself yourself herself himself if off above we have because more before these
those were where there here are some same me while the she he once be and would should could did had a"""
_SHORT = {"'d": "he she we i you they", "'re": "you we they", "'ve": "i we you they", "'ll": "he she we i you they", "'m": "i", "'s": "he she here there where when who that what let it how why"}
_NEGATED = "can sha had did could should would are were have do wo has was does is must"

STOPWORDS = frozenset(_BARE.split()) | {w + end for end, words in _SHORT.items() for w in words.split()} | {w + ("'t" if w == "can" else "n't") for w in _NEGATED.split()}
