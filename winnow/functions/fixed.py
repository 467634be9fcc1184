"""Fixed values that results depend on: word lists, maps, patterns and formats."""

# --- fixed values: moderation lexicon ---
LEXICON = (
    "amk", "amq", "sik", "siktir", "sikerim", "sikeyim", "sikim", "orospu", "orospuçocuğu", "oç", "piç", "pic",
    "piçkurusu", "yavşak", "yavsak", "gavat", "ibne", "sürtük", "surtuk", "fahişe", "pezevenk", "kahpe", "kaltak",
    "salak", "aptal", "gerizekalı", "gerzek", "dangalak", "ahmak", "embesil", "bok", "boktan", "hıyar", "puşt",
    "göt", "götveren", "şerefsiz", "serefsiz", "namussuz", "alçak", "aşağılık", "döl", "yarrak", "taşak",
)
CONTEXTUAL = (
    "salak", "aptal", "gerizekalı", "gerzek", "dangalak", "ahmak", "embesil", "bok", "boktan", "hıyar", "göt",
    "götveren", "döl", "taşak",
)
#: \b and \s are rewritten for Unicode by functions.rx.
PHRASES = (
    r"seni\s*öldür",
    r"anan[ıi]\s*sik",
    r"seni\s*sik",
    r"kafan[ıi]\s*k[ıi]r",
    r"gebertir",
    r"doğduğuna\s*pişman",
    r"hay\s*anan",
    r"\bseni\s+mal\b",
    r"\bmal\s+mısın\b",
    r"\bmal\s+misin\b",
    r"\bne\s+mal\b",
    r"\bbu\s+mal\b",
    r"\bşu\s+mal\b",
    r"\badi\s+herif",
    r"\badi\s+insan",
    r"\b(?:sen|seni|siz|bu|şu|o)\s+(?:salak|aptal|gerizekalı|gerzek|dangalak|ahmak|embesil|hıyar)\b",
    r"\b(?:salak|aptal|gerizekalı|gerzek|dangalak|ahmak|embesil)\s+m[ıi]s[ıi]n\b",
)
THREATS = ("öldür", "gebert", "bıçak", "silah", "kafanı kır")
PLAIN_FROM, PLAIN_TO = "çğöşüÇĞÖŞÜ", "cgosuCGOSU"
RULE_LEET_FROM, RULE_LEET_TO = "@4^8(<{3€69#1!|05$§7+", "aaabccceegghiiiossstt"
RULE_LEET_MARK = "[@4^83€69#1!|05$§7+]"
EMOJIS = {
    "🤡": "palyaço", "💩": "dışkı emojisi", "🖕": "orta parmak hakaret", "🐷": "domuz", "🐕": "köpek", "🤮": "kusma",
    "💀": "ölüm", "🔪": "bıçak", "🔫": "silah", "👊": "yumruk", "🐍": "yılan", "🤢": "iğrenme",
}
MODEL_LEET_FROM, MODEL_LEET_TO = "@43€691!|05$§7+", "aaeeggiiiossstt"
INVISIBLE = r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff\ufff9-\ufffb]"
#: The same with the spaces of fixed width and without the first, for the opt-in plain form.
INVISIBLE_SPACES = r"[\u200b-\u200f\u2060-\u2064\ufeff\ufffe\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u2000-\u200a\u202a-\u202e\u2066-\u2069\ufff9-\ufffb]"
#: Version of these normal forms, in every manifest.
PREPROCESSING_VERSION = "winnow-normal-1"
STOPWORDS = tuple(
    """
    acaba ama ancak artık asla aslında az bazı bazen belki ben beni benim beri
    beş bile bir birçok biri birkaç biz bize bizim bu buna bunda bundan bunlar
    bunları bunların çünkü da daha de defa diye eğer en gibi hem hep hepsi her
    herkes hiç için ile ise işte kadar kendi kendine kez ki kim kimi kime kimin
    mı mi mu mü nasıl ne neden nede nerede nereye niçin o olan olarak oldu olmak
    olsa onu onun onlar onları onların öyle pek rağmen sadece sanki sen seni
    senin siz size sizin sonra şu şuna şunda şundan şunlar tarafından üzere var
    ve veya ya yani yine kullanici url rt
    """.split()
)
# --- fixed values: labelled tables ---
TEXT_ALIASES = ("text", "metin", "message", "mesaj", "content", "icerik", "tweet", "comment", "yorum", "sentence", "cumle")
LABEL_ALIASES = ("is_toxic", "label", "toxic", "offensive", "is_offensive", "class", "sinif", "etiket", "target")
GROUP_ALIASES = (
    "base_key", "original_text", "root_text", "parent_text", "augmentation_group", "conversation_id", "thread_id",
    "user_id", "author_id", "account_id", "kullanici_id", "grup_id",
)
TEXTUAL_GROUPS = ("base_key", "original_text", "root_text", "parent_text")
AGREEMENT_ALIASES = ("agreement", "annotator_agreement", "uzlasma", "uyum")
NOTES_ALIASES = ("notes", "note", "notlar", "aciklama")
POSITIVE = (
    "1", "true", "yes", "evet", "toxic", "offensive", "abusive", "attack", "hate", "hakaret", "saldirgan", "saldırgan",
    "nefret", "insult", "threat", "profanity", "targeted abuse", "sexual profanity", "targeted harassment",
    "harassment", "cyberbullying", "off", "label 1",
)
NEGATIVE = (
    "0", "false", "no", "hayir", "hayır", "clean", "normal", "neutral", "not toxic", "non toxic", "not offensive",
    "non offensive", "not", "label 0",
)
DISAGREEMENT = ("0", "false", "no", "hayir", "hayır", "disagree", "uyusmuyor")
SKIPPED_DIRECTORIES = (
    ".git", ".venv", "venv", "env", "__pycache__", "modeller", "sonuclar", "grafikler", "veri_setleri", "temiz_veri",
    ".runtime", "reports", "rapor",
)
#: Folders below a project (or from it) that may hold raw files, in order, after the variable's folder.
RAW_VARIABLE = "RAW_DATA_DIR"
RAW_FOLDERS = ("ham_veri", "raw_data", ".", "../veri setleri ve url", "..")
#: Names of sources by their files' names and folders.
SPLIT_STEMS = ("train", "valid", "validation", "test")
NUMBERED_SOURCE, HUB_MARK, HUB_SOURCE = "uploaded_", "turkish_toxic", "huggingface"
COMPETITION_FOLDERS, COMPETITION_SOURCE, UNKNOWN_SOURCE = ("ham_veri", "veri_setleri_ve_url"), "kaggle", "bilinmeyen"
