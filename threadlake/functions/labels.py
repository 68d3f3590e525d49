"""Label vocabularies, keyword tables, stop words and character classes."""

EMOTIONS = {
    "romantic": ["love", "miss you", "cute", "pretty", "jaan", "pyaar", "hug", "kiss", "beautiful"],
    "supportive": ["proud", "take care", "good luck", "i am here", "don't worry", "you can", "support"],
    "funny": ["haha", "hahaha", "hehe", "lol", "lmao", "pagal", "funny", "joke"],
    "conflict": ["angry", "upset", "hurt", "annoyed", "why did", "leave me", "fine then", "not fair"],
    "nostalgic": ["remember", "old days", "back then", "first time", "used to", "those days"],
}
ARCHETYPES = {
    "check-in": ["where are you", "what are you doing", "awake", "home", "reached", "u there"],
    "affection": ["love", "miss you", "cute", "pretty", "hug", "kiss", "heart"],
    "planning": ["tomorrow", "plan", "schedule", "meet", "trip", "let's", "shall we"],
    "humor_banter": ["haha", "hahaha", "hehe", "lol", "joking", "pagal", "stupid", "tease"],
    "reassurance": ["don't worry", "it's okay", "i am here", "proud of you", "you can do it"],
    "conflict": ["angry", "upset", "hurt", "leave", "not fair", "why did"],
    "repair_reconnection": ["sorry", "forgive", "missed you", "glad we're talking", "patch up"],
    "longing_missing": ["miss you", "wish you were", "come here", "distance", "want to see you"],
    "everyday_life": ["class", "sleep", "food", "lunch", "uni", "office", "work", "home"],
    "future_imagining": ["one day", "future", "marry", "together", "our life", "kids"],
}
TOPICS = {
    "daily_life": ["sleep", "food", "home", "class", "uni", "office", "today", "busy"],
    "future_plans": ["tomorrow", "trip", "plan", "future", "schedule", "meet"],
    "relationship": ["us", "together", "relationship", "love", "feelings"],
    "humor": ["haha", "hehe", "lol", "joking", "meme"],
    "difficult_conversation": ["upset", "hurt", "sorry", "angry", "cry"],
    "study_work": ["class", "exam", "assignment", "work", "meeting", "marks"],
    "travel": ["trip", "flight", "swat", "kashmir", "travel", "visit"],
    "support": ["proud", "good luck", "take care", "support", "i am here"],
    "longing": ["miss you", "come here", "wish you were", "distance"],
}
SUPPORT = ["proud", "take care", "good luck", "don't worry"]
REPAIR = ["sorry", "forgive", "it's okay", "patch up"]
INTIMACY = ["love", "miss you", "hug", "kiss", "jaan", "babe", "sweetie", "baby", "cute"]
BANTER = ["haha", "lmao", "lol", "pagal", "stupid", "joke", "hehe"]
INSTITUTIONAL = ["http", "www", "forwarded", "announce", "dear all", "regards", "best,", "event", "deadline", "submit", "linkedin", "please find", "attached"]
STOP_WORDS = ["a", "an", "and", "are", "be", "for", "from", "hai", "i", "in", "is", "it", "ka", "ki", "ko", "me", "of", "on", "or", "the", "to", "tu", "tum", "u", "ya", "ye"]
LATE_HOURS = [22, 23, 0, 1, 2, 3, 4]
SESSION_GAP, CHUNK_SIZE, CHUNK_OVERLAP = 360, 120, 15
#: White space as ECMAScript has it.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Extended_Pictographic and Emoji_Presentation.
EMOJI = (
    "[\\x{A9}\\x{AE}\\x{203C}\\x{2049}\\x{2122}\\x{2139}\\x{2194}-\\x{2199}\\x{21A9}\\x{21AA}\\x{231A}\\x{231B}\\x{2328}\\x{2388}\\x{23CF}\\x{23E9}-\\x{23F3}\\x{23F8}-\\x{23FA}\\x{24C2}\\x{25AA}\\x{25AB}\\x{25B6}\\x{25C0}\\x{25FB}-\\x{25FE}"
    "\\x{2600}-\\x{2605}\\x{2607}-\\x{2612}\\x{2614}-\\x{2685}\\x{2690}-\\x{2705}\\x{2708}-\\x{2712}\\x{2714}\\x{2716}\\x{271D}\\x{2721}\\x{2728}\\x{2733}\\x{2734}\\x{2744}\\x{2747}\\x{274C}\\x{274E}\\x{2753}-\\x{2755}\\x{2757}\\x{2763}-\\x{2767}\\x{2795}-\\x{2797}"
    "\\x{27A1}\\x{27B0}\\x{27BF}\\x{2934}\\x{2935}\\x{2B05}-\\x{2B07}\\x{2B1B}\\x{2B1C}\\x{2B50}\\x{2B55}\\x{3030}\\x{303D}\\x{3297}\\x{3299}\\x{1F000}-\\x{1F0FF}\\x{1F10D}-\\x{1F10F}\\x{1F12F}\\x{1F16C}-\\x{1F171}\\x{1F17E}\\x{1F17F}\\x{1F18E}\\x{1F191}-\\x{1F19A}"
    "\\x{1F1AD}-\\x{1F1FF}\\x{1F201}-\\x{1F20F}\\x{1F21A}\\x{1F22F}\\x{1F232}-\\x{1F23A}\\x{1F23C}-\\x{1F23F}\\x{1F249}-\\x{1F53D}\\x{1F546}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F774}-\\x{1F77F}\\x{1F7D5}-\\x{1F7FF}\\x{1F80C}-\\x{1F80F}\\x{1F848}-\\x{1F84F}"
    "\\x{1F85A}-\\x{1F85F}\\x{1F888}-\\x{1F88F}\\x{1F8AE}-\\x{1F8FF}\\x{1F90C}-\\x{1F93A}\\x{1F93C}-\\x{1F945}\\x{1F947}-\\x{1FAFF}\\x{1FC00}-\\x{1FFFD}]"
)
