"""Word lists, patterns, formats and tables that results depend on."""

# --- fixed values: token prefix per type -------------------------------------------------------------
TOKEN_PREFIXES = {
    "email": "ANONEMAIL",
    "phone": "ANONPHONE",
    "iban": "ANONIBAN",
    "apikey": "ANONKEY",
    "password": "ANONPASS",
    "username": "ANONUSER",
    "firstname": "ANONFIRST",
    "lastname": "ANONLAST",
    "address": "ANONADDR",
    "hostname": "ANONHOST",
    "filepath_user": "ANONUSER",
    "name": "ANONNAME",
    "social_handle": "ANONHANDLE",
}
UNKNOWN_PREFIX = "ANONUNK"

# --- fixed values: phone context, key context, hash context -------------------------------------------
PHONE_STOP_CONTEXT = r"(?iU)(?:hash|sha\d*|md5|version|v\d|port|pid|uid|gid|size|bytes|offset|0x)"
KEY_CONTEXT = (
    r"(?iU)(?:api[_-]?key|token|secret|password|bearer|authorization|auth[_-]?token|"
    r"access[_-]?key|private[_-]?key|client[_-]?secret|app[_-]?secret)"
)
HASH_CONTEXT = r"(?iU)(?:md5|sha1|sha256|sha512|hash|checksum|digest|signature|fingerprint|cert)"

# --- fixed values: value patterns ----------------------------------------------------------------------
PHONE_PATTERNS = [
    ("international", r"\+\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{1,4}[\s.-]?\d{1,4}[\s.-]?\d{0,4}\b"),
    ("trunk_zero", r"\b0\d{1,3}[\s/.-]\d{2,3}[\s.-]\d{2}[\s.-]\d{2}\b"),
    ("area_in_brackets", r"\(\d{3}\)\s?\d{3}[-.]?\d{4}\b"),
    ("three_groups", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
]
EMAIL_PATTERN = (
    r"\b[a-zA-Z0-9][a-zA-Z0-9._%+-]*@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}\b"
)
IBAN_PATTERN = r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4}\b"
# name, value, whether it stands between quotes, blanks or signs
KEY_PATTERNS = [
    ("cloud_access_id", r"\b(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b", False),
    ("cloud_secret", r"[A-Za-z0-9+/]{40}", True),
    ("maps_key", r"\bAIza[0-9A-Za-z_-]{35}\b", False),
    ("payment_key", r"\b[sr]k_(?:live|test)_[0-9a-zA-Z]{24,}\b", False),
    ("lower_hex", r"\b[a-f0-9]{32,64}\b", False),
    ("forge_token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}\b", False),
    ("bot_token", r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b", False),
    ("long_alnum", r"[A-Za-z0-9]{32,}", True),
]
KEY_OPENING, KEY_CLOSING = r"[\s=\"':]", r"[\s\"';\n]"
HEX_IS_LABEL = r"\s*[.:]"
DRIVE_PATH, DRIVE_USER = r"[A-Za-z]:\\Users\\", r"[^\\/:*?\"<>|\s]+"
HOME_PATH, HOME_USER = "/home/", r"[^/\s]+"
HOST_PATTERN = r"\b(?:LAPTOP|DESKTOP|PC|WORKSTATION|NB|NOTEBOOK)[-_][A-Za-z][A-Za-z0-9_-]{2,}\b"
USERNAME_VALUE = r"[a-zA-Z][a-zA-Z0-9._-]{2,30}"
USERNAME_WORDS = r"(?:for|user|User|USER|login|Login|account|Account)\s+"
USERNAME_ASSIGNED = r"(?:username|user|operator|admin|owner)\s*[=:]\s*[\"']?"
USERNAME_KEYS = r"username|user_?name|subscriber|account_?name|login_?name|member_?name|caller_?id"
AT_HANDLE, U_HANDLE = r"@[A-Za-z][A-Za-z0-9._]{0,29}", r"u/[A-Za-z0-9_-]{3,20}"
SOCIAL_KEYS = (
    r"screen[_\s]?name|snap(?:chat)?[_\s]?(?:user(?:name)?|handle)"
    r"|(?:twitter|instagram|tiktok|telegram|discord|reddit|youtube|facebook|fb)"
    r"[_\s]?(?:user(?:name)?|handle|name|screen[_\s]?name)"
    r"|user[_\s]?handle|social[_\s]?handle"
)
SOCIAL_VALUE = r"[A-Za-z][A-Za-z0-9._-]{1,30}"
TAG_PATTERN = r"\b[A-Za-z][A-Za-z0-9._-]{1,31}#\d{4}\b"

# --- fixed values: words that are never a value --------------------------------------------------------
SYSTEM_ACCOUNTS = [
    "public", "default", "all users", "default user", "administrator",
    "admin", "root", "system", "local service", "network service",
    "defaultapppool", "guest", "www-data", "nobody", "daemon",
]
USERNAME_STOP = [
    "root", "admin", "administrator", "system", "nobody", "daemon",
    "www-data", "nginx", "apache", "mysql", "postgres", "redis",
    "guest", "anonymous", "unknown", "null", "none", "default",
    "localhost", "config", "updated", "deleted", "created", "failed",
    "invalid", "public", "private", "internal", "external",
    "true", "false", "yes", "error", "warning", "info", "debug",
    "admin_backup",
]
HANDLE_STOP = [
    "everyone", "here", "channel", "all", "admin", "support",
    "help", "info", "news", "official", "bot", "status",
    "api", "dev", "docs", "app", "web", "mail", "team",
    "mention", "param", "type", "nullable", "override",
    "deprecated", "property", "interface", "class", "extends",
    "implements", "abstract", "static", "return", "import",
]
LABEL_STOP = [
    "", "null", "none", "n/a", "unknown", "undefined", "not set",
    "true", "false", "yes", "no",
    "admin", "root", "system", "administrator", "default", "guest",
    "test", "example", "demo", "sample",
    "verified", "unverified", "active", "inactive", "pending",
]
EXPORT_STOP = [
    "", "true", "false", "active", "deleted", "not enabled", "sms",
    "username", "email_address", "phone_number", "display_name",
    "old_value", "new_value", "timestamp", "reason", "action", "date",
]

# --- fixed values: field labels ------------------------------------------------------------------------
NAME_LABELS = (
    r"display[_\s]?name|full[_\s]?name|real[_\s]?name"
    r"|subscriber[_\s]?name|account[_\s]?name|holder[_\s]?name"
    r"|contact[_\s]?name|customer[_\s]?name|owner[_\s]?name"
    r"|first[_\s]?name|last[_\s]?name|family[_\s]?name|given[_\s]?name"
    r"|naam|achternaam|voornaam"
)
USERNAME_LABELS = (
    r"user[_\s]?name|login[_\s]?name|screen[_\s]?name|nick[_\s]?name"
    r"|user[_\s]?id|account[_\s]?id|member[_\s]?name|caller[_\s]?id"
    r"|sender[_\s]?name|author[_\s]?name|creator[_\s]?name"
    r"|gebruikersnaam"
)
ADDRESS_LABELS = (
    r"address|street[_\s]?address|home[_\s]?address|postal[_\s]?address"
    r"|mailing[_\s]?address|residence|domicile"
    r"|adres|woonadres|verblijfplaats"
)
CONTACT_LABELS = (
    r"phone[_\s]?number|telephone|mobile[_\s]?number|cell[_\s]?phone"
    r"|contact[_\s]?number|gsm[_\s]?number|tel[_\s]?number"
    r"|telefoon|gsm|mobiel"
)

# --- fixed values: profile addresses (site, path before the user, user part, literals of the site) --------
PROFILE_URLS = [
    ("instagram", r"(?:www\.)?instagram\.com/(?!p/|reel/|stories/|explore/|accounts/)", r"[A-Za-z0-9._]{1,30}",
     ("instagram.com/",)),
    ("twitter", r"(?:www\.)?(?:twitter|x)\.com/(?!status/|i/|search|hashtag|intent)", r"[A-Za-z0-9_]{1,15}",
     ("twitter.com/", "x.com/")),
    ("facebook", r"(?:www\.)?facebook\.com/(?!groups/|pages/|events/|marketplace/|watch/)", r"[A-Za-z0-9.]{1,50}",
     ("facebook.com/",)),
    ("tiktok", r"(?:www\.)?tiktok\.com/@", r"[A-Za-z0-9._]{1,24}", ("tiktok.com/@",)),
    ("linkedin", r"(?:www\.)?linkedin\.com/in/", r"[A-Za-z0-9-]{3,100}", ("linkedin.com/in/",)),
    ("youtube", r"(?:www\.)?youtube\.com/@", r"[A-Za-z0-9._-]{1,30}", ("youtube.com/@",)),
    ("telegram", r"t\.me/(?!joinchat/|addstickers/|\+)", r"[A-Za-z][A-Za-z0-9_]{4,31}", ("t.me/",)),
    ("snapchat", r"(?:www\.)?snapchat\.com/add/", r"[A-Za-z][A-Za-z0-9._-]{2,14}", ("snapchat.com/add/",)),
    ("reddit", r"(?:www\.)?reddit\.com/u(?:ser)?/", r"[A-Za-z0-9_-]{3,20}", ("reddit.com/u",)),
]

# --- fixed values: provider export ----------------------------------------------------------------------
SUBSCRIBER_HEADER = (
    "username,email_address,email_status,pending_email_address,created,"
    "creation_ip,phone_number,phone_status,pending_phone_number,"
    "former_phone_number,display_name,status"
)
SUBSCRIBER_COLUMNS = [
    (0, "username"), (1, "email"), (3, "email"), (6, "phone"), (8, "phone"), (9, "phone"), (10, "name"),
]
HISTORY_TIME = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC"

# --- fixed values: protected technical patterns (name, pattern, flags) -----------------------------------
PROTECTED_PATTERNS = [
    ("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "Ud"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "Ud"),
    ("md5", r"\b[0-9a-fA-F]{32}\b", "Ud"),
    ("sha1", r"\b[0-9a-fA-F]{40}\b", "Ud"),
    ("sha256", r"\b[0-9a-fA-F]{64}\b", "Ud"),
    ("mitre", r"\b[Tt][Aa]?\d{4}(?:\.\d{3})?\b", "Ud"),
    ("iso_time", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "Ud"),
    ("syslog_time",
     r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b", "Ud"),
    ("protocol",
     r"\b(?:TCP|UDP|HTTP|HTTPS|SSH|RDP|FTP|DNS|SMTP|IMAP|POP3|TLS|SSL|NTP|SNMP|LDAP|SMB|ICMP)\b", "Ud"),
    ("process",
     r"\b(?:svchost|explorer|cmd|powershell|rundll32|csrss|lsass|winlogon|services|spoolsv|taskhost|conhost"
     r"|dllhost|msiexec|wscript|cscript|nginx|apache|httpd|sshd|systemd|cron|bash|sh|python|java|node)"
     r"(?:\.exe)?\b", "iUd"),
    ("port", r"(?:port\s+|:)\d{1,5}\b", "iUd"),
    ("mac", r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b", "Ud"),
]

# --- fixed values: file formats -----------------------------------------------------------------------
TEXT_EXTENSIONS = [
    ".txt", ".log", ".md", ".conf", ".cfg", ".ini", ".sql", ".php", ".xml", ".html", ".htm",
    ".yaml", ".yml", ".json", ".sh", ".bat", ".ps1", ".py", ".js", ".eml", ".env", ".properties",
]
TABLE_EXTENSIONS = {".csv": ",", ".tsv": "\t"}

# --- fixed values: column name to type, first hit wins ---------------------------------------------------
COLUMN_TYPE_HINTS = [
    (["email"], "email"),
    (["phone", "mobile", "gsm", "tel"], "phone"),
    (["user", "login", "screen", "nick"], "username"),
    (["name", "naam"], "name"),
    (["address", "adres"], "address"),
    (["iban"], "iban"),
    (["bio"], "name"),
]
COLUMN_TYPE_DEFAULT = "name"

# --- fixed values: provider templates --------------------------------------------------------------------
TEMPLATES = {
    "microsoft-signin": {
        "description": "Sign-ins of an office tenant",
        "pii_columns": ["UserPrincipalName", "DisplayName", "DeviceName"],
        "keep_columns": ["IPAddress", "Timestamp", "Location", "Status", "AppDisplayName"],
    },
    "microsoft-audit": {
        "description": "Audit trail of an office tenant",
        "pii_columns": ["UserId", "UserKey", "ObjectId"],
        "keep_columns": ["CreationDate", "Operation", "Workload", "ClientIP", "ResultStatus"],
    },
    "isp-connection": {
        "description": "Connections of an internet provider's customers",
        "pii_columns": ["subscriber_name", "subscriber_email", "subscriber_address", "account_holder"],
        "keep_columns": ["source_ip", "dest_ip", "dest_port", "protocol", "timestamp", "bytes_sent",
                         "session_duration"],
    },
    "crypto-kyc": {
        "description": "Customer checks of a coin exchange",
        "pii_columns": ["full_name", "email", "phone", "address", "date_of_birth", "iban"],
        "keep_columns": ["user_id", "currency", "amount", "wallet_address", "ip", "transaction_id"],
    },
    "google-account": {
        "description": "Export of a web account",
        "pii_columns": ["name", "email", "phone", "recovery_email", "recovery_phone"],
        "keep_columns": ["ip_address", "timestamp", "activity_type", "device_id"],
    },
    "telegram-user": {
        "description": "Users and messages of a messenger",
        "pii_columns": ["username", "Username", "first_name", "last_name", "Name", "phone_number", "Phone", "bio"],
        "keep_columns": ["user_id", "ID", "date", "DTG", "message_id", "chat_id", "ip_address", "IP", "Type"],
    },
    "meta-records": {
        "description": "Subscriber records of social networks",
        "pii_columns": ["name", "email", "phone", "vanity_name", "screen_name"],
        "keep_columns": ["uid", "ip_address", "timestamp", "registration_ip", "machine_cookie"],
    },
}

# --- fixed values: word-list column names, first existing one is used -------------------------------------
WORD_LIST_COLUMNS = {
    "firstname": ["voornaam", "firstname", "name"],
    "lastname": ["achternaam", "lastname", "name"],
    "address": ["street"],
}
MIN_NAME_LENGTH = 4
MIN_STREET_LENGTH = 5
