"""Fixed values that results depend on: patterns, word lists, factors and limits."""

# Character classes follow Unicode on every JDK: a word character is a letter, number or "_".
# Patterns put their first own character before the boundary test, which is the costlier one.
WORD = r"\p{L}\p{N}_"
EDGE = rf"(?<![{WORD}])"  # no word character before
STOP = rf"(?![{WORD}])"  # no word character after
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
DIGIT = r"\p{Nd}"


def after(first: str) -> str:
    """One character of class ``first`` that starts a word."""
    return rf"{first}(?<![{WORD}]{first})"


# --- fixed values: identifier patterns -------------------------------------
HEX = "[0-9A-Fa-f]"
HEX_GROUPS = rf"(?:{HEX}{{4}}(?:{SPACE}|-)?){{9}}{HEX}{{4}}"
PGP_LABEL = rf"(?i:PGP|GPG|fingerprint|fpr|fp)(?::|{SPACE})*"
HEX40 = rf"(?={HEX}{{40}}){EDGE}{HEX}{{40}}{STOP}"
PGP_BLOCK = r"-----BEGIN PGP PUBLIC KEY BLOCK-----.*?-----END PGP PUBLIC KEY BLOCK-----"
BASE58 = "[1-9A-HJ-NP-Za-km-z]"
BTC_BECH32 = rf"(?i){after('b')}c1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{{38,62}}{STOP}"
BTC_LEGACY = rf"{after('1')}{BASE58}{{25,34}}{STOP}"
BTC_P2SH = rf"{after('3')}{BASE58}{{25,34}}{STOP}"
ETH = rf"{after('0')}x{HEX}{{40}}{STOP}"
TRON = rf"{after('T')}{BASE58}{{33}}{STOP}"
XMR = rf"{after('4')}[0-9A-Za-z]{{94}}{STOP}"
# a word may start at a letter, or at punctuation right after a word
MAIL_START = rf"(?:(?<![{WORD}])[a-zA-Z0-9_]|(?<=[{WORD}])[.%+\-])"
EMAIL = rf"{MAIL_START}[a-zA-Z0-9._%+\-]*+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}{STOP}"
# no dot in the label, so it never needs to give characters back
DOMAIN = rf"(?=[a-zA-Z0-9]){EDGE}[a-zA-Z0-9][a-zA-Z0-9\-]{{0,62}}+(?<!-)\.[a-zA-Z]{{2,}}{STOP}"
ONION_V3 = rf"(?i)(?=[a-z2-7]{{56}}\.){EDGE}[a-z2-7]{{56}}\.onion{STOP}"
TELEGRAM = rf"{after('@')}[a-zA-Z][a-zA-Z0-9_]{{4,31}}{STOP}"
XMPP = rf"{MAIL_START}[a-zA-Z0-9._%+\-]*+@(?i:jabber|xmpp|conversations)\.[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}{STOP}"
SESSION_ID = rf"{after('0')}5{HEX}{{64}}{STOP}"
WICKR = rf"(?i:wickr|wickr\.me)(?::|{SPACE})+([a-zA-Z0-9_]{{3,20}})"
OCTET = rf"(?:25[0-5]|2[0-4]{DIGIT}|[01]?{DIGIT}{DIGIT}?)"
IPV4 = rf"(?={DIGIT}{{1,3}}\.){EDGE}(?:{OCTET}\.){{3}}{OCTET}{STOP}"
NOISE_TLDS = ["com", "org", "net", "edu", "gov", "io", "co"]

# --- fixed values: page, archive and relay-contact patterns -----------------
PAGE_BTC = rf"(?=[13b]){EDGE}((?:1|3){BASE58}{{25,34}}|bc1[a-zA-HJ-NP-Z0-9]{{25,62}}){STOP}"
PAGE_XMR = rf"{after('4')}[0-9AB]{BASE58}{{93}}{STOP}"
# a local part that starts inside a longer one cannot match unless a match ended there
LOOSE_EMAIL = rf"(?:\G|(?<![{WORD}.+\-]))[{WORD}.+\-]++@[{WORD}\-]+\.[{WORD}.\-]+"
LOOSE_HEX40 = rf"{HEX}{{40}}"
LOOSE_HANDLE = rf"@[{WORD}]{{3,30}}"
ONION_URL = r"https?://[a-z2-7]{56}\.onion[^\s\"'<>]*"
ARCHIVE_BTC = rf"(?=[13]){EDGE}(?:1|3){BASE58}{{25,34}}{STOP}"
ARCHIVE_VENDOR = rf"(?i:vendor|seller|shop){SPACE}*:{SPACE}*([^\s\p{{Z}}\x1c-\x1f\x85]+)"
CONTACT_SHORT_KEY = rf"0x{HEX}{{8,16}}"
CONTACT_URL = rf"https?://[{WORD}./?&=%\-]+"
HREF = r"href=[\"']([^\"']+)[\"']"
META_GENERATOR = rf"<meta{SPACE}+name=[\"']generator[\"']{SPACE}+content=[\"']([^\"']+)[\"']"

# --- fixed values: redaction, in order of application -----------------------
GAP = rf"(?:{SPACE}|-)?"
REDACTION_RULES = [
    ("aadhaar", rf"(?={DIGIT}{{4}}){EDGE}{DIGIT}{{4}}{GAP}{DIGIT}{{4}}{GAP}{DIGIT}{{4}}{STOP}", "[AADHAAR_REDACTED]"),
    ("pan", rf"(?=[A-Z]{{5}}){EDGE}[A-Z]{{5}}{DIGIT}{{4}}[A-Z]{STOP}", "[PAN_REDACTED]"),
    (
        "phone",
        rf"(?=[+(\p{{Nd}}])(?:\+?{DIGIT}{{1,3}}{GAP})?\(?{DIGIT}{{3,5}}\)?{GAP}{DIGIT}{{3,4}}{GAP}{DIGIT}{{3,4}}{STOP}",
        "[PHONE_REDACTED]",
    ),
    (
        "victim_email",
        rf"{MAIL_START}[a-zA-Z0-9._%+\-]*+@(?!protonmail\.|tutanota\.|cock\.li|dnmx\.|onionmail\.)"
        rf"[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}{STOP}",
        "[EMAIL_REDACTED]",
    ),
]

# --- fixed values: policy and safety gates ----------------------------------
ALLOWED_CONTENT_TYPES = ["text/html", "text/plain", "application/json", "application/xml"]
MAX_CONTENT_BYTES = 10 * 1024 * 1024
BLOCKED_MIME_PREFIXES = [
    "image/", "video/", "audio/", "application/zip", "application/x-rar", "application/x-tar",
    "application/gzip", "application/x-7z", "application/octet-stream", "application/pdf",
    "application/x-executable", "application/x-msdownload",
]
PROHIBITED_PATTERNS = [
    (rf"{after('c')}hild{SPACE}+(?:abuse|exploitation|pornograph){STOP}", "child"),
    (rf"{after('r')}ecruit(?:ing|ment){SPACE}+for{SPACE}+(?:jihad|terror){STOP}", "recruit"),
]
INTERNAL_HOST_PREFIXES = [
    "localhost", "127.0.0.1", "0.0.0.0", "169.254.", "10.", "172.16.", "172.17.", "172.18.",
    "172.19.", "172.20.", "172.21.", "172.22.", "172.23.", "172.24.", "172.25.", "172.26.",
    "172.27.", "172.28.", "172.29.", "172.30.", "172.31.", "192.168.",
    "metadata.google.internal", "metadata.aws.internal",
]

# --- fixed values: feeds -----------------------------------------------------
GROUP_ALIASES = {
    "lockbit": ["lockbit3", "lockbit 3.0", "lockbit3.0", "lockbit 3", "lockbit2"],
    "alphv": ["blackcat", "alphv/blackcat", "alphv blackcat", "noberus"],
    "clop": ["cl0p", "clop ransomware", "ta505"],
    "blackbasta": ["black basta"],
    "royallocker": ["royal", "royal ransomware", "blacksuit"],
    "bianlian": ["bian lian"],
    "play": ["play ransomware", "playcrypt"],
    "medusa": ["medusa ransomware", "medusa locker", "medusalocker"],
    "akira": ["akira ransomware"],
    "rhysida": ["rhysida ransomware"],
    "hunters": ["hunters international", "hunters intl"],
    "8base": ["8base ransomware"],
    "noescape": ["no escape"],
    "ransomhub": ["ransom hub"],
}
ADVISORY_KEYWORDS = [
    "ransomware", "lockbit", "blackcat", "alphv", "clop", "royal", "akira", "rhysida", "play",
    "medusa", "bianlian", "conti",
]
ATTACK_GROUPS = {
    "g0016": "apt29", "g0022": "apt3", "g0026": "apt18", "g0032": "lazarus", "g0034": "sandworm",
    "g0035": "dragonfly", "g0045": "menupass", "g0049": "oilrig", "g0050": "apt32",
    "g0059": "magic_hound", "g0064": "apt33", "g0074": "wizard_spider", "g0078": "gorgon_group",
    "g0080": "cobalt_group", "g0092": "ta505", "g0096": "apt41", "g0102": "fin7",
    "g0108": "blue_mockingbird", "g0114": "chimera", "g0119": "indrik_spider",
    "g0125": "hafnium", "g0129": "mustang_panda",
}
WATCH_PATTERNS = [".onion", "lockbit", "blackcat", "alphv", "ransom", "leak"]
FINGERPRINT_HEADERS = [
    "server", "x-powered-by", "x-aspnet-version", "x-generator", "x-content-type-options",
    "strict-transport-security", "set-cookie", "via", "x-frame-options", "x-xss-protection",
]

# --- fixed values: entity kinds, graph labels and edge types ----------------
KIND_LABELS = {
    "pgp": "PGPKey", "wallet": "Wallet", "email": "Email", "domain": "Domain", "onion": "Onion",
    "contact_id": "ContactID", "handle": "Handle", "ip": "IP", "avatar_hash": "AvatarHash",
    "cert_fp": "Cert", "ssh_key": "SSHKey", "favicon_hash": "Favicon",
}
STATS_LABELS = ["Actor", "Handle", "Wallet", "PGPKey", "Email", "Onion", "ContactID", "Domain", "IP", "WalletCluster"]
STATS_EDGES = ["USES", "LINKED_TO", "SHARES_FINGERPRINT", "SHARES_CLOCK_SKEW", "MEMBER_OF", "SENT_TO"]

# --- fixed values: likelihood-ratio model -----------------------------------
EVIDENCE_TYPES = {  # name: (ratio, family, description)
    "pgp_fingerprint": (1000.0, "key", "Same PGP fingerprint"),
    "ssh_key": (1000.0, "infra", "Same SSH host key"),
    "contact_id": (500.0, "contact", "Same contact identifier"),
    "cert_san": (300.0, "infra", "TLS cert names clearnet domain"),
    "wallet_cluster": (200.0, "financial", "Same wallet cluster"),
    "wallet_transfer": (50.0, "financial", "Direct wallet-to-wallet transfer"),
    "favicon": (30.0, "infra", "Same favicon hash"),
    "handle_exact": (30.0, "handle", "Exact handle match"),
    "avatar_hash": (20.0, "handle", "Same avatar hash"),
    "handle_similar": (5.0, "handle", "Similar handle (Jaro-Winkler ≥ 0.90)"),
    "stylometry": (10.0, "linguistic", "Similar writing profile"),
    "code_switch": (8.0, "linguistic", "Similar code-switch pattern"),
    "banner": (3.0, "infra", "Same server banner"),
    "temporal_overlap": (2.5, "temporal", "Overlapping activity window"),
    "tx_timing": (3.0, "temporal", "Correlated transaction timing"),
}
RELIABILITY = {"A": 1.0, "B": 0.85, "C": 0.70, "D": 0.50, "E": 0.30, "F": 0.0}
CREDIBILITY = {1: 1.0, 2: 0.90, 3: 0.75, 4: 0.55, 5: 0.35, 6: 0.15}
FAMILY_CAPS = {"temporal": 0.5, "handle": 3.0}
PRIOR_ODDS = 0.001
WHY_TEXTS = {
    "pgp_fingerprint": "Same PGP fingerprint",
    "ssh_key": "Same SSH host key",
    "contact_id": "Same contact identifier",
    "wallet_cluster": "Same wallet cluster",
    "wallet_transfer": "Direct wallet-to-wallet transfer",
    "cert_san": "TLS certificate names clearnet domain",
    "favicon": "Same favicon hash",
    "handle_exact": "Exact handle match",
    "handle_similar": "Similar handle",
    "stylometry": "Similar writing profile",
    "temporal_overlap": "Overlapping activity window",
    "banner": "Same server banner",
    "avatar_hash": "Same avatar hash",
    "code_switch": "Similar code-switch pattern",
}

# --- fixed values: infrastructure detectors ---------------------------------
NOISE_BANNERS = ["nginx", "apache", "cloudflare", "microsoft-iis", "nginx/1.18.0", "apache/2.4.41"]
STATUS_PATTERNS = [
    rf"(?i)ServerName:{SPACE}*(\S+)",
    rf"(?i)hostname[\"']?{SPACE}*[:=]{SPACE}*[\"']?(\S+)",
    rf"server_name{SPACE}+(\S+);",
]

# --- fixed values: stylometry ------------------------------------------------
FUNCTION_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had "
    "do does did will would could should may might shall can need must i you he she it we they me "
    "him her us them my your his its our their this that these those not no if then"
).split()
PUNCTUATION = ".,!?;:-'\"()[]{}"
MIN_STYLE_CHARS = 100
