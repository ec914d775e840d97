"""Word lists, phrases and patterns that results depend on."""

from __future__ import annotations

# --- fixed values: function words of the text profile (22) and of the HTML gate (20) ---
PROFILE_STOPWORDS = ("the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on", "as", "are", "was", "this", "by", "an", "or", "from")
HTML_STOPWORDS = tuple(w for w in PROFILE_STOPWORDS if w not in ("an", "or"))

# --- fixed values: navigation phrases, and those of them that only the mutation oracle knows ---
BOILERPLATE = (
    "skip to content", "cookie preferences", "accept all cookies", "subscribe to our newsletter", "all rights reserved",
    "privacy policy", "terms of service", "sign in", "log in", "create an account", "share on twitter", "share on facebook",
    "follow us", "read more", "advertisement", "sponsored content", "back to top", "main navigation", "you may also like",
    "related articles", "leave a comment", "click here to subscribe", "menu", "search this site", "add to cart",
)
BOILERPLATE_HELDOUT = ("read more", "accept all cookies", "terms of service", "share on twitter", "cookie preferences", "click here to subscribe")
BOILERPLATE_TRAIN = tuple(p for p in BOILERPLATE if p not in BOILERPLATE_HELDOUT)

# --- fixed values: tokens of leaked code ---
CODE_TOKENS = ("function(", "var ", "const ", "let ", "{", "}", "px;", "@media", "addEventListener", "document.", "window.", "</", "/>", "&nbsp;", "&amp;")

# --- fixed values: character confusions of recognition ---
OCR_CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("l", "1"), ("I", "l"), ("O", "0"), ("0", "O"), ("S", "5"), ("B", "8"),
    ("cl", "d"), ("vv", "w"), ("ii", "ü"), ("fi", "ti"), ("e", "c"), ("a", "o"), ("g", "q"), ("h", "b"),
)
OCR_HELDOUT = (("h", "b"), ("rn", "m"), ("a", "o"), ("B", "8"))
OCR_TRAIN = tuple(p for p in OCR_CONFUSIONS if p not in OCR_HELDOUT)

# --- fixed values: fragments of misdecoded text, glyphs of scan noise, vowels, short words ---
MOJIBAKE = ("Ã©", "Ã¨", "Ã¼", "Ã±", "â€™", "â€œ", "â€\x9d", "â€“", "Â ", "Â·", "ï¿½", "�")
MOJIBAKE_SIGNS = ("Ã", "Â", "â€", "ï¿½", "�", "Ð", "Ñ")
NOISE_GLYPHS = "¬|~^`¦§¤°±¶•◊�"
INJECTED_GLYPHS = "¬|~^`¦§°±•"
VOWELS = "aeiouyAEIOUYàâäéèêëïîôöùûüáíóúñ"
SHORT_WORDS = ("a", "i", "an", "of", "to", "is", "in", "it", "on", "or", "as", "by", "we", "he", "be", "do", "no", "so", "up", "at", "my", "me", "us", "am", "if", "go", "ok", "the", "and")

# --- fixed values: markers of risk and contradiction, and the blocklist of the cheap score ---
RISK = (
    "buy now and click here for free money", "act now limited time offer", "guaranteed to cure all diseases", "wire the payment immediately",
    "send your password and social security number", "this is not financial advice but invest all", "miracle weight loss no diet",
    "you have won the lottery claim your prize", "hot singles in your area", "download this crack for free",
)
RISK_HELDOUT = ("this is not financial advice but invest all", "wire the payment immediately")
RISK_TRAIN = tuple(p for p in RISK if p not in RISK_HELDOUT)
CONTRADICTIONS = (
    "however the opposite is also definitely true", "this never happened although it clearly did",
    "the figure is exactly 10 and also exactly 1000", "it is both completely safe and extremely dangerous",
    "the study found no effect and a huge effect simultaneously", "always avoid this and always do this",
    "the temperature was below zero and boiling at once", "nobody agrees and everybody agrees on this point",
)
CONTRADICTIONS_HELDOUT = ("the figure is exactly 10 and also exactly 1000", "however the opposite is also definitely true")
CONTRADICTIONS_TRAIN = tuple(p for p in CONTRADICTIONS if p not in CONTRADICTIONS_HELDOUT)
SPAM = ("click here", "free money", "act now", "buy now", "viagra", "lottery", "wire the payment", "miracle", "hot singles", "download this crack", "claim your prize", "no diet", "guaranteed to cure")

# --- fixed values: what mutation operators insert ---
INJECTED_TAGS = ('<div class="col">', "<span>", "<p>", "</p>", "</div>", "&nbsp;", "&amp;", "<!-- ad -->", "<br/>")
SCRIPT_BLOCK = "<script>function track(){var x=window.location;document.addEventListener('click',track);}</script><style>.nav{display:flex;padding:10px;margin:0px;}@media{}</style>"

# --- fixed values: sentence parts of generated prose ---
SUBJECTS = (
    "the researcher", "a recent study", "the committee", "this method", "the enzyme", "the algorithm", "the author", "the river system",
    "the central bank", "the telescope", "the immune response", "the dataset", "the medieval city", "the new policy", "the protein", "the population",
)
VERBS = (
    "demonstrates", "measured", "concluded that", "describes", "increased", "analyzed", "reported", "suggests that", "produced", "examined",
    "improved", "observed that", "estimated", "revealed", "supported",
)
OBJECTS = (
    "a significant effect on the outcome", "the underlying mechanism in detail", "several important properties of the material",
    "the relationship between the variables", "a measurable reduction in the error rate", "the historical context of the period",
    "the structure of the observed signal", "consistent results across conditions", "the distribution of the sampled values",
    "a plausible explanation for the trend",
)
CONNECTORS = (
    "In addition,", "However,", "As a result,", "For example,", "In contrast,", "Notably,", "According to the report,",
    "Over the following years,", "Although the evidence was limited,", "Based on these observations,",
)
HEADINGS = ("Background And Methods", "Overview", "Results", "Historical Context", "Materials And Methods", "Discussion", "Key Findings", "Introduction")
LIST_ITEMS = ("a higher sampling rate", "the control group", "improved baselines", "the revised estimate", "additional measurements", "the second cohort")
CLEAN_SOURCES = ("web", "encyclopedia", "academic", "forum")

# --- fixed values: patterns (Java syntax). White space and word characters are Unicode's ---
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
TOKEN = r"[^\p{IsWhite_Space}\x1c-\x1f]+"
WORD = r"[\p{L}\p{Nl}\p{No}]+"
TAG = r"</?[a-zA-Z][^>]{0,80}>"
HTML_ENTITY = r"&[a-zA-Z]{2,10};|&#\d{1,5};"
LINK = r"https?://|www\.|\]\(http|\[[^\]]{1,40}\]\([^)]+\)"
NUMBER = r"(?U)\b\d[\d,.]*\b"
PROPER_NOUN = r"(?<=[a-z]\s)[A-Z][a-z]{2,}"

FEATURES = (
    "char_length", "token_length", "mean_word_length", "gzip_ratio", "type_token_ratio", "bigram_repetition", "top_ngram_fraction",
    "dup_line_fraction", "stopword_fraction", "alpha_fraction", "digit_fraction", "punct_fraction", "uppercase_fraction",
    "non_ascii_fraction", "symbol_word_ratio", "bullet_line_fraction", "ellipsis_line_fraction", "short_line_fraction",
    "mean_line_length", "mojibake_fraction",
)
