"""Phrase lists and cue patterns used by the role rules.

Everything here is a fixed value: results depend on the exact phrases, so they
are stated literally and in their usual order.
"""

# --- fixed values: phrases that mark a channel call to action -----------------
CTA_BROAD = [
    "subscribe", "hit the subscribe button", "subscribe to the channel",
    "subscribe to my channel", "don't forget to subscribe",
    "like and subscribe", "subscribe below", "click subscribe",
    "hit the bell", "notification bell", "smash that subscribe",
    "leave a like", "hit the like button", "thumbs up",
    "check out the description", "link in the description",
    "patreon", "support the channel", "support the show",
]
CTA_STRICT = [
    "hit the subscribe button", "subscribe to the channel",
    "subscribe to my channel", "don't forget to subscribe",
    "like and subscribe", "subscribe below", "click subscribe",
    "smash that subscribe", "hit the bell", "notification bell",
    "leave a like", "hit the like button",
    "check out the description", "link in the description",
    "support the channel", "support the show",
    "patreon",
]
CTA_STRICT_THIS = [
    "subscribe to this channel", "subscribe to the channel",
    "subscribe to my channel", "hit the subscribe button",
    "like and subscribe", "subscribe below", "click subscribe",
    "smash that subscribe", "don't forget to subscribe",
    "hit the bell", "notification bell",
    "leave a like", "hit the like button",
    "check out the description", "link in the description",
    "support the channel", "support the show",
    "patreon",
]
CTA_FULL = [
    "subscribe to this channel", "subscribe to the channel",
    "subscribe to my channel", "subscribe to our channel",
    "hit the subscribe button", "click the subscribe button",
    "like and subscribe", "subscribe below", "click subscribe",
    "smash that subscribe", "don't forget to subscribe",
    "go subscribe", "please subscribe",
    "hit the bell", "notification bell",
    "leave a like", "hit the like button",
    "check out the description", "link in the description",
    "support the channel", "support the show",
    "patreon",
    "subscribe our", "subscribe my",
    "clips channel", "shorts channel",
    "clips and", "shorts and",
]

# --- fixed values: phrases only a host says -----------------------------------
HOST_V2 = [
    "welcome to", "welcome back", "welcome back to",
    "thanks for joining", "glad you could join", "great to have you",
    "thank you for being here", "thank you so much for being here",
    "thanks for coming on", "thanks for being on the show",
    "today we have", "today i'm joined by", "today i'm talking to",
    "my guest today", "i'm here with", "joining me today",
    "thanks for listening", "thank you for listening",
    "hope you enjoyed", "hope you had fun", "hope you learned",
    "that's all for today", "that's it for today",
    "see you next time", "until next time", "catch you next time",
    "don't forget to subscribe", "make sure to subscribe",
    "let's dive in", "let's get into it", "let's talk about",
    "i want to ask you", "i wanted to ask", "can i ask you",
]
HOST_V4 = [
    "welcome to", "welcome back", "welcome back to",
    "thanks for joining", "glad you could join", "great to have you",
    "thank you for being here", "thank you so much for being here",
    "thanks for coming on", "thanks for being on the show",
    "today we have", "today i'm joined by", "today i'm talking to",
    "my guest today", "joining me today",
    "thanks for listening", "thank you for listening",
    "that's all for today", "that's it for today",
    "see you next time", "until next time", "catch you next time",
    "i'll see you next time",
    "don't forget to subscribe", "make sure to subscribe",
]
HOST_V5 = [
    "welcome to", "welcome back", "welcome back to",
    "thanks for joining", "glad you could join", "great to have you",
    "thank you for being here", "thank you so much for being here",
    "thanks for coming on", "thanks for being on the show",
    "having you on", "having you here", "having you today",
    "glad to have you", "honored to have you",
    "today we have", "today i'm joined by", "today i'm talking to",
    "my guest today", "joining me today",
    "today's guest", "on the show today", "on the podcast today",
    "i've got", "we've got", "i have with me",
    "today we spoke to", "today we spoke with", "today i spoke to", "today i spoke with",
    "we spoke to", "we spoke with", "i spoke to", "i spoke with",
    "in today's episode we", "in this episode we",
    "on this podcast", "on this show", "on this episode",
    "every episode", "every guest",
    "this episode is going to be", "people will watch this episode",
    "as a podcast host",
    "today s episode is with", "today s episode is about",
    "in today s episode", "in this episode",
    "thanks for listening", "thank you for listening",
    "that's all for today", "that's it for today",
    "see you next time", "until next time", "catch you next time",
    "i'll see you next time",
    "don't forget to subscribe", "make sure to subscribe",
    "subscribe to this channel",
    "thank you so much for watching", "thanks for watching",
    "until the next episode", "see you in the next episode",
]

# --- fixed values: phrases only a guest says ----------------------------------
GUEST_V5 = [
    "thank you for having me", "thanks for having me",
    "thank you for having me on your podcast", "thank you for having me on your show",
    "thank you for having me on", "thanks for having me on",
    "happy to be here", "glad to be here", "excited to be here",
    "honored to be here", "great to be here", "pleasure to be here",
    "it's an honor to be on", "love being on your show", "love being on your podcast",
]

# --- fixed values: sponsor reads ----------------------------------------------
SPONSOR_V1 = [
    "sponsor", "brought to you by", "today's sponsor",
    "this episode is sponsored", "this podcast is brought",
    "promo code", "discount code", "coupon code",
    "visit", "go to", "check out",
    "percent off", "% off", "discount",
    "audible", "squarespace", "hellofresh", "betterhelp",
    "nord vpn", "nordvpn", "athletic greens",
    "before we get started", "before we dive in",
    "quick word from our sponsor", "message from our sponsor",
    "thanks to our sponsor",
]
SPONSOR_V2 = [
    "sponsor", "brought to you by", "today's sponsor",
    "this episode is sponsored", "this podcast is brought",
    "promo code", "discount code", "coupon code",
    "percent off", "% off", "discount",
    "audible", "squarespace", "hellofresh", "betterhelp",
    "nordvpn", "athletic greens",
    "before we get started", "before we dive in",
    "quick word from our sponsor", "message from our sponsor",
]
SPONSOR_GENDERED = [
    "sponsor", "brought to you by", "today's sponsor",
    "this episode is sponsored", "this podcast is brought",
    "promo code", "discount code", "coupon code",
    "percent off", "% off", "discount",
    "audible", "squarespace", "hellofresh", "betterhelp",
    "nordvpn", "athletic greens",
    "before we get started", "before we dive in",
    "quick word from our sponsor", "message from our sponsor",
    "thanks to our sponsor",
]
SPONSOR_V4 = [
    "sponsor", "brought to you by", "today's sponsor",
    "this episode is sponsored", "this podcast is brought",
    "promo code", "discount code", "coupon code",
    "percent off", "% off",
    "audible", "squarespace", "hellofresh", "betterhelp",
    "nordvpn", "athletic greens",
    "quick word from our sponsor", "message from our sponsor",
]

# --- fixed values: openings and closings --------------------------------------
INTRO_OUTRO = [
    "welcome to", "welcome back", "thanks for listening",
    "that's all for today", "see you next time",
    "don't forget to subscribe", "leave a review",
    "if you enjoyed this episode",
]

# --- fixed values: question detection -----------------------------------------
QUESTION_STARTERS = [
    "what", "why", "how", "when", "where", "who", "which",
    "can you", "could you", "would you", "will you", "should",
    "do you", "did you", "does", "have you", "has",
    "is it", "are you", "was", "were",
    "tell me", "explain",
]
QUESTION_WORDS = [
    "what", "why", "how", "when", "where", "who",
    "do you", "can you", "is it", "would", "could", "should",
]

# --- fixed values: host-likeness scoring patterns, matched as whole words on
# lower-cased text
HOST_SCORE_QUESTION_CUES = [
    "why", "how", "what", "when", "where",
    "do you", "can you", "tell me", "help me", "walk me through",
]
HOST_SCORE_PHRASES = [
    "today'?s episode", "welcome", "subscribe", "comment(?:s)?",
    "share (?:it|this)", "enjoy (?:the )?show",
    "thank you for (?:watching|listening)", "we spoke to", "introduc(?:e|ing)",
]
HOST_SCORE_INTERJECTION = (
    r"^\s*(yeah|yes|right|okay|ok|hmm|interesting|true|got it)\s*[\.\!]*\s*$"
)

# --- fixed values: early-snippet cues of the fallback host score, whole words --
HOST_CUES = [
    "episode", "podcast", "welcome", "thank(?:s)?", "special thanks",
    "subscribe", "follow", "TRS", "show", "we(?:'ve)?",
]


def whole_words(patterns: list[str]) -> str:
    return r"\b(?:" + "|".join(patterns) + r")\b"


# Detection variants: categories in priority order. `strip_punct` says whether
# punctuation in the text becomes a space before matching.
DETECTION_VARIANTS = {
    "v1": {"order": [("youtube_cta", CTA_BROAD), ("sponsor", SPONSOR_V1), ("intro_outro", INTRO_OUTRO)], "strip_punct": False},
    "v2": {"order": [("host_phrases", HOST_V2), ("youtube_cta", CTA_BROAD), ("sponsor", SPONSOR_V2)], "strip_punct": False},
    "v3": {"order": [("host_phrases", HOST_V2), ("youtube_cta", CTA_STRICT), ("sponsor", SPONSOR_V2)], "strip_punct": False},
    "v4": {"order": [("youtube_cta", CTA_STRICT_THIS), ("host_phrases", HOST_V4), ("sponsor", SPONSOR_V4)], "strip_punct": False},
    "v5": {"order": [("youtube_cta", CTA_FULL), ("host_phrases", HOST_V5), ("guest_phrases", GUEST_V5), ("sponsor", SPONSOR_V4)], "strip_punct": True},
    "combined": {"order": [("youtube_cta", CTA_BROAD), ("sponsor", SPONSOR_V2)], "strip_punct": False},
    "with_gender": {"order": [("youtube_cta", CTA_BROAD), ("sponsor", SPONSOR_GENDERED), ("intro_outro", INTRO_OUTRO)], "strip_punct": False},
}
