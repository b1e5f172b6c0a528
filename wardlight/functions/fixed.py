"""Word lists, labels and limits that results depend on.  They are stated, not computed."""

# Gambling: one word of the first list settles it, the second needs more than one, the third never suffices.
GAMBLING_DEFINITIVE = """online betting site
real money casino
real-money casino
mobile casino app
gambling website
betting website
online gambling
online casino
live casino
live dealers
live dealer
gambling site
betting site
sports book
sportsbook
sportbook
casino app
bookmakers
bookmaker
casinos
casino""".split("\n")

GAMBLING_STRONG = """progressive jackpot
instant withdrawals
instant withdrawal
instant payouts
instant payout
fast withdrawals
fast withdrawal
fast payouts
fast payout
no deposit bonus
slot machines
slot machine
return to player
medium volatility
high volatility
low volatility
slot volatility
game volatility
online slots
video slots
free spins
free spin
table games
house edge
megaways
jackpot
RTP
texas holdem
texas hold'em
omaha poker
caribbean stud
video poker
blackjack
baccarat
roulette
pai gow
poker
craps
live sports betting
sports betting
in-play betting
in play betting
asian handicap
handicap bet
point spread
betting markets
betting odds
cash out bet
cashout bet
money line
moneyline
match odds
over under
over/under
prop bets
prop bet
odds boost
bet slip
accumulator
parlay
champions league betting
champions league odds
premier league betting
premier league odds
super bowl betting
world cup betting
euroleague betting
basketball betting
basketball odds
football betting
football odds
baseball betting
formula 1 betting
table tennis betting
volleyball betting
horse racing betting
greyhound betting
Wimbledon betting
soccer betting
soccer odds
tennis betting
tennis odds
hockey betting
cricket betting
cricket odds
boxing betting
racing odds
FIFA betting
golf betting
darts betting
snooker betting
rugby betting
F1 betting
ATP betting
IPL betting
UFC betting
MMA betting
NFL betting
NFL odds
NBA betting
NBA odds
MLB betting
MLB odds
NHL betting
NHL odds
live esports betting
bet on esports
e-sports betting
esports betting
esports odds
Counter-Strike betting
League of Legends betting
Call of Duty betting
Mobile Legends betting
Rocket League betting
FIFA esports betting
StarCraft betting
Overwatch betting
Valorant betting
Wild Rift betting
eFootball betting
Dota 2 betting
LoL betting
PUBG betting
CS2 betting""".split("\n")

GAMBLING_WEAK = """betting
bets
bet
odds
slots
slot
spins
spin
volatility
payouts
payout
withdrawals
withdrawal
bingo
keno
Premier League
Champions League
football
soccer
basketball
baseball
tennis
hockey
cricket
boxing
rugby
NBA
NFL
MLB
NHL
UFC
MMA
IPL
Dota 2
Valorant
Overwatch
Counter-Strike
League of Legends
Mobile Legends
PUBG
CS2""".split("\n")

GAMBLING_VETOES = ["limited slots", "time slots", "time slot", "parking slot", "SIM slot", "job slot", "expansion slot", "interview slot"]

ADULT_DEFINITIVE = ["xxx videos", "xxx video", "adult video", "porn tube", "sex cam", "cam girl", "pornstar", "onlyfans", "hentai", "porno", "nsfw", "porn"]
ADULT_STRONG = ["18+ content", "explicit video", "webcam show", "live cam", "sex chat", "escort", "erotic", "nude", "naked"]
ADULT_WEAK = ["adults only", "mature content", "dating", "18+"]
ADULT_VETOES = ["adult supervision", "adult education", "young adult", "adult learner", "adult learning", "adult daycare", "adult day care"]
ADULT_AGE_GATE = ["i am over 18", "i am 18", "over 18 years", "enter if 18", "age verification", "confirm your age", "verify your age", "must be 18"]
ADULT_TLDS = ["xxx", "porn", "sex", "adult"]

SHOP_TLDS = ["top", "shop", "xyz", "biz", "click", "gq", "tk", "ml", "ga", "cf"]
WEBMAIL = "gmail|googlemail|yahoo|ymail|hotmail|outlook|live|msn|aol|icloud|mail"
CHAT_HOSTS = ["wa.me", "api.whatsapp.com", "web.whatsapp.com", "t.me", "telegram.me", "line.me", "m.me"]
CURRENCIES = "[$£€¥₹₩₽]|USD|EUR|GBP|MYR|AUD|CAD|JPY|INR|CNY|SGD"

# Trust navigation, tried in this order.
TRUST_CATEGORIES = {
    "privacy": r"\bprivacy(?:\s+policy)?\b",
    "policy": r"\bpolicies?\b",
    "terms": r"\bterms(?:\s+(?:of\s+(?:service|use)|and\s+conditions|conditions))?\b",
    "help": r"\bhelp(?:\s+(?:center|centre|desk|page))?\b",
    "security": r"\bsecurity\b",
    "support": r"\bsupport\b",
    "services": r"\bservices?\b",
    "contact": r"\bcontact(?:\s+us)?\b|\bcustomer\s+(?:service|support)\b",
}
COPYRIGHT = r"©|&copy;|&#169;|&#x0*a9;|\(\s*c\s*\)|\bcopyright\b|all\s+rights\s+reserved"
SOFT_404 = ["product not found", "no active numbers", "page not found"]
BRAND_ATTRIBUTES = "alt aria-label aria-labelledby title content class id name value property href src srcset data-src action poster".split()
ORIGINAL_PRICE_TAGS, ORIGINAL_PRICE_CLASSES = ["del", "s", "strike"], ["old-price", "original-price", "compare-at", "compare-at-price", "regular-price"]
SALE_PRICE_CLASSES = ["sale-price", "special-price", "new-price", "current-price", "price-sale", "discounted-price"]
PRICE_LOOKALIKE = r"[$£€¥₹]\s*\d+|\d+\s*[$£€¥₹]|USD|EUR|GBP|MYR|AUD|CAD|JPY|INR|CNY|SGD"

PARKING_NAME_SERVERS = """domaincontrol.com afternic.com cashparking.com namefind.com sedoparking.com bodis.com parkingcrew.net dan.com
undeveloped.com parklogic.com ztomy.com parking.namecheap.com parkingpage.namecheap.com expireddomains above.com alter.com brandbucket.com
dns-parking.com domain-for-sale.at domain-for-sale.se domainmarket.com domainrecover.com dsredirection.com dsredirects.com eftydns.com
onamae-expired.com park.io""".split()
PARKING_IPS = ["3.33.130.190", "15.197.148.33", "34.102.136.180", "34.98.99.30", "64.190.63.222", "208.91.197.27"]
PARKING_SUBNETS = ["198.54.117."]

FREE_CAS = ["let's encrypt", "zerossl", "cpanel", "r3", "e1", "e5", "r10", "r11"]
PRIVACY_WORDS = ["privacy", "redacted", "proxy", "protected", "whoisguard", "domains by proxy", "contact privacy"]
INACTIVE_STATUSES = ["inactive", "redemptionperiod", "serverhold", "pendingdelete", "pendingrestorationrequest"]
SINKHOLES = ["0.0.0.0", "127.0.0.1", "::", "::1"]
DENIED_STATUSES = [451, 403, 410]
PROVIDERS = {
    "CDN": ["cloudflare", "fastly", "akamai", "cdn77", "bunny"],
    "MajorCloud": ["amazon", "google", "microsoft", "azure", "digitalocean", "linode", "vultr", "hetzner"],
    "SharedHosting": ["godaddy", "bluehost", "hostgator", "namecheap", "siteground", "hostinger"],
    "CheapVPS": ["frantech", "buyvm", "serverius", "hostwinds", "virmach", "netcup"],
}

# Similarity at which a concept counts, and what follows from concepts: (fact, concepts of which one suffices, level).
LEVELS = {"weak": 0.55, "medium": 0.63, "strong": 0.78}
CONCEPT_FACTS = [
    ("semantic_account_verification_language_detected", ["accountVerificationScore"], "medium"),
    ("semantic_strong_account_verification_language_detected", ["accountVerificationScore"], "strong"),
    ("semantic_credential_login_language_detected", ["credentialLoginScore"], "medium"),
    ("semantic_password_reset_language_detected", ["passwordResetScore"], "medium"),
    ("semantic_otp_verification_language_detected", ["otpVerificationScore"], "medium"),
    ("semantic_recruitment_language_detected", ["recruitmentScore"], "medium"),
    ("semantic_recruitment_fee_language_detected", ["recruitmentFeeScore"], "medium"),
    ("semantic_investment_scam_language_detected", ["investmentScamScore"], "medium"),
    ("semantic_fee_collection_language_detected", ["feeCollectionScore"], "medium"),
    ("semantic_support_payment_scam_language_detected", ["supportPaymentScamScore"], "medium"),
    ("semantic_reward_or_grant_scam_language_detected", ["rewardOrGrantScamScore"], "medium"),
    ("semantic_gambling_language_detected", ["gamblingScore"], "medium"),
    ("semantic_adult_content_language_detected", ["adultContentScore"], "medium"),
    ("semantic_parking_language_detected", ["parkingScore"], "medium"),
    ("semantic_official_brand_tone_detected", ["brandOfficialToneScore"], "medium"),
    ("semantic_urgency_language_detected", ["urgencyScore"], "medium"),
    ("semantic_phishing_language_detected", ["accountVerificationScore", "credentialLoginScore", "passwordResetScore", "otpVerificationScore"], "medium"),
    ("semantic_scam_language_detected", ["investmentScamScore", "feeCollectionScore", "supportPaymentScamScore", "rewardOrGrantScamScore", "recruitmentFeeScore"], "medium"),
    ("semantic_transaction_language_detected", ["shoppingScore", "checkoutScore", "paymentScore"], "medium"),
]

# Hosts whose requests a capture does without.
BLOCKED_HOSTS = """doubleclick.net googlesyndication.com google-analytics.com adservice.google.com connect.facebook.net quantserve.com
outbrain.com taboola.com adnxs.com intercom.io drift.com hs-scripts.com zendesk.com onetrust.com cookiebot.com trustarc.com
usercentrics.eu cookielaw.org""".split()

# The patterns of tags, scripts and attributes that pages are searched for; results depend on each of them.
INPUT_TAG = "(?i)<input[^>]*>"
FILE_TAG = r"(?i)<input[^>]*type\s*=\s*['\"]?file['\"]?[^>]*>"
FORM_TAG = "(?i)<form[^>]*>"
FORM_ACTION = r"(?i)action\s*=\s*['\"]([^'\"]*)['\"]"
REFRESH_TAG = r"(?i)<meta[^>]*http-equiv\s*=\s*['\"]?refresh['\"]?[^>]*>"
META = r"(?i)<meta[^>]*http-equiv\s*=\s*['\"]?refresh['\"]?[^>]*content\s*=\s*['\"]?[0-9]+\s*;\s*url\s*=\s*([^'\">]+)['\"]?"
ASSIGN = r"(?i)(?:window\.)?location(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]"
METHOD = r"(?i)(?:window\.)?location\.(?:replace|assign)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
# What name, id or autocomplete may start with, for each kind of input.
INPUT_NAMES = {
    "password": "password|pass|pwd|pin",
    "username": "username|userid|user_name|login|email",
    "otp": "otp|mfa|one-time-code|verification_code|2fa|auth_code",
    "financial": "cc-number|cardnumber|card-number|cvv|cvc|accountnumber|routingnumber|cc-csc|cc-exp|bank_account",
    "identity": "passport|passport_number|passportno|ssn|social_security|national_id|id_number|idcard|nric|identity_number|document_number",
}

# From which share of dead links a page's links count as dead, from which share of all links one address is the
# dominant one, how many samples are shown, and the links that aren't probed.
DEAD_RATIO, DOMINANT_SHARE, SAMPLES = 0.5, 0.3, 5
SKIPPED = ("mailto:", "tel:", "sms:", "data:", "blob:")

# What failed navigation over https says; certificates are looked for first.
CERTIFICATE = r"(?i)ERR_CERT|CERT_AUTHORITY|CERT_DATE|CERT_COMMON_NAME|certificate"
CONNECTION = r"(?i)ERR_SSL|SSL_PROTOCOL_ERROR|ERR_CONNECTION_CLOSED|ERR_CONNECTION_RESET|ERR_CONNECTION_REFUSED|ERR_CONNECTION_TIMED_OUT|ERR_TIMED_OUT"
