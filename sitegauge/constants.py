"""Everything below has to equal the audit rules we reproduce.

Word lists, lookup tables, thresholds and message texts only; no logic.
"""

# --- fixed values: module lookup, first key contained in the first path segment wins ---
MODULE_KEYS = [
    ("login", "Authentication"), ("signin", "Authentication"),
    ("signup", "Authentication"), ("register", "Authentication"),
    ("auth", "Authentication"), ("logout", "Authentication"),
    ("checkout", "Checkout"), ("payment", "Checkout"),
    ("cart", "Cart"), ("basket", "Cart"),
    ("order", "Orders"), ("orders", "Orders"),
    ("dashboard", "Dashboard"),
    ("admin", "Admin Panel"),
    ("profile", "User Profile"), ("account", "User Profile"), ("user", "User Profile"),
    ("settings", "Settings"), ("config", "Settings"),
    ("search", "Search"),
    ("product", "Product Pages"), ("products", "Product Pages"),
    ("shop", "Product Pages"), ("store", "Product Pages"),
    ("category", "Product Pages"),
    ("blog", "Blog/Content"), ("news", "Blog/Content"),
    ("article", "Blog/Content"), ("post", "Blog/Content"),
    ("contact", "Contact"),
    ("about", "About"),
    ("help", "Help/Support"), ("support", "Help/Support"), ("faq", "Help/Support"),
    ("api", "API"),
    ("docs", "Documentation"), ("documentation", "Documentation"),
    ("pricing", "Pricing"), ("plans", "Pricing"),
    ("gallery", "Media"), ("media", "Media"),
    ("portfolio", "Portfolio"),
    ("services", "Services"),
    ("careers", "Careers"), ("jobs", "Careers"),
    ("terms", "Legal"), ("privacy", "Legal"), ("legal", "Legal"),
    ("404", "Error Pages"), ("error", "Error Pages"),
]
HOMEPAGE = "Homepage"

# --- fixed values: white space beyond the ASCII set of \s, as a character class ---
OTHER_SPACE = (r"\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
               r"\x{202f}\x{205f}\x{3000}")
# --- fixed values: common named character references of HTML, all but &amp; ---
NAMED_REFERENCES = [
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "\\'"), ("nbsp", "\u00a0"), ("copy", "©"), ("reg", "®"),
    ("trade", "™"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("lsquo", "‘"), ("rsquo", "’"),
    ("ldquo", "“"), ("rdquo", "”"), ("laquo", "«"), ("raquo", "»"), ("middot", "·"), ("bull", "•"),
    ("euro", "€"), ("pound", "£"), ("deg", "°"), ("times", "×"), ("sect", "§"), ("ensp", "\u2002"),
    ("emsp", "\u2003"), ("thinsp", "\u2009"), ("agrave", "à"), ("aacute", "á"), ("acirc", "â"), ("atilde", "ã"),
    ("auml", "ä"), ("ccedil", "ç"), ("egrave", "è"), ("eacute", "é"), ("ecirc", "ê"), ("euml", "ë"),
    ("iacute", "í"), ("icirc", "î"), ("iuml", "ï"), ("ntilde", "ñ"), ("oacute", "ó"), ("ocirc", "ô"),
    ("ouml", "ö"), ("uacute", "ú"), ("ugrave", "ù"), ("uuml", "ü"), ("Auml", "Ä"), ("Eacute", "É"),
    ("Ouml", "Ö"), ("Uuml", "Ü"), ("szlig", "ß")]

# --- fixed values: crawl limits, status codes, schemes ---
MAX_PAGES = 50
MAX_EXTERNAL_CHECKS = 20
TIMEOUT_SECONDS = 10
AGENT_TOKEN = "mozilla"
GONE_CODES = [404, 410]
SERVER_ERROR_CODES = [500, 502, 503]
BROKEN_INTERNAL_CODES = [404, 410, 500, 502, 503]
BROKEN_EXTERNAL_CODES = [0, 404, 403, 410, 500, 502, 503]
SKIPPED_HREF_PREFIXES = ["#", "mailto:", "tel:", "javascript:"]
NO_DOMAIN_MESSAGE = "Invalid URL — no domain found."
BLOCKED_ERROR = "robots_blocked"
BLOCKED_MESSAGE = "Crawl blocked by robots.txt. Uncheck 'Respect robots.txt' in the sidebar to override."
UNPARSABLE_MESSAGE = "Could not parse the URL."

# --- fixed values: severities and the four-slot status draw per severity ---
SEVERITY_WEIGHTS = {"Low": 1.0, "Medium": 2.0, "High": 3.0}
STATUS_SLOTS = {
    "Low": ["Open", "Fixed", "Open", "Open"],
    "Medium": ["Open", "Open", "Reopened", "Fixed"],
    "High": ["Open", "Open", "Open", "Reopened"],
}

# --- fixed values: health score weights, grades (lower bound, grade, color) ---
HEALTH_WEIGHTS = [
    ("Issues", 0.25), ("Broken Links", 0.20), ("Performance", 0.20), ("SEO", 0.15),
    ("Accessibility", 0.10), ("Meta Tags", 0.05), ("Mobile", 0.05),
]
GRADES = [(80, "A", "green"), (65, "B", "orange"), (50, "C", "#FF8C00"), (35, "D", "red")]
LOWEST_GRADE = ("F", "darkred")
EMPTY_GRADE = ("F", "red")

# --- fixed values: how each health category is described ---
CATEGORY_TEXTS = [
    ("Issues", "⚠️", "25%",
     "How many High-severity issues exist per page crawled",
     "100 − (high_issue_count ÷ pages × 50)",
     "≥ 70 means fewer than ~0.6 high issues per page"),
    ("Broken Links", "🔗", "20%",
     "Links returning HTTP 404 / 5xx or that could not connect",
     "100 − (broken_count ÷ pages × 200)",
     "0 broken links = 100. Even 1 per 10 pages drops score to 80"),
    ("Performance", "⚡", "20%",
     "Average HTTP response time across all pages (timed by crawler stopwatch)",
     "100 − (avg_load_seconds − 1.0) × 15",
     "Pages loading under 2.5s score above 76 (Google Core Web Vitals target)"),
    ("SEO", "🔍", "15%",
     "Pages that have a non-empty <title> tag",
     "pages_with_title ÷ total_pages × 100",
     "100 = every page has a title. Missing titles lose clicks in search results"),
    ("Accessibility", "♿", "10%",
     "<img> tags with a non-empty alt attribute (WCAG 2.1 rule 1.1.1)",
     "images_with_alt ÷ total_images × 100",
     "100 = all images described. Screen readers need this to work"),
    ("Meta Tags", "🏷️", "5%",
     "Pages with a <meta name='description'> tag (the text shown in Google search results)",
     "pages_with_meta_desc ÷ total_pages × 100",
     "100 = every page controls its search snippet. Missing = Google writes its own"),
    ("Mobile", "📱", "5%",
     "Pages with a <meta name='viewport'> tag (tells mobile browsers how to scale the page)",
     "pages_with_viewport ÷ total_pages × 100",
     "100 = all pages are mobile-ready. Missing = page appears zoomed-out on phones"),
]

# --- fixed values: words dropped from issue texts ---
STOPWORDS = [
    "a", "an", "the", "is", "it", "in", "on", "at", "to", "for", "of", "and", "or", "but",
    "not", "with", "this", "that", "has", "have", "are", "was", "were", "be", "been",
    "being", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "shall", "can", "which", "from", "by", "as", "its", "their", "there", "than", "also",
    "no", "all", "more", "into", "url", "page", "http", "https", "www", "html", "css",
    "js", "tag", "tags", "returns", "return", "has", "lack", "lacks", "impacts",
]
EMPTY_TEXT_TOKEN = "issue"
VOCABULARY_SIZE = 100
TOP_KEYWORDS = 20
MIN_ISSUES_FOR_TEXT = 3
TEXT_GUARD_MESSAGE = "Need ≥ 3 issues for NLP analysis."

# --- fixed values: classifier settings ---
SEED = 42
FOREST_TREES = 100
FOREST_DEPTH = 5
MIN_ISSUES_FOR_MODEL = 8
MODEL_GUARD_MESSAGE = "Not enough data for ML model (need ≥ 8 issues)."
LABEL_NAMES = ["Not Critical", "Critical"]
FEATURE_LABELS = [
    ("module_enc", "Module"), ("type_enc", "Issue Type"), ("occurrences", "Occurrences"),
    ("fix_time_hours", "Fix Time"), ("severity_weight", "Severity"),
]

# --- fixed values: what to test per module, first key contained in the module wins ---
MODULE_FOCUS = [
    ("Authentication", "Login/logout flows, session management, password reset, brute force"),
    ("Checkout", "Payment flow, cart persistence, discount codes, order confirmation"),
    ("Cart", "Add/remove items, quantity updates, total accuracy, session persistence"),
    ("Dashboard", "Data accuracy, chart rendering, real-time updates, permissions"),
    ("User Profile", "Edit profile, avatar upload, password change, privacy settings"),
    ("Search", "Empty results, special chars, pagination, relevance ranking"),
    ("Product Pages", "Images, pricing, stock status, add-to-cart functionality"),
    ("Admin Panel", "Access control, CRUD, audit logs, bulk actions"),
    ("Blog/Content", "Rich text, media embedding, comments, pagination"),
    ("Help/Support", "Search accuracy, ticket submission, response tracking"),
]
DEFAULT_FOCUS = "Functional testing, link validation, form submission, content accuracy"

# --- fixed values: recommendation texts (priority, category, detail, effort, impact) ---
REC_BROKEN = (1, "Critical",
              "Broken links hurt UX and SEO. Use monthly link-checker scans. "
              "Add 301 redirects for moved pages and a custom 404 page.", "Low", "High")
REC_FORMS = (2, "Critical",
             "Add HTML5 required/pattern/type=email attributes. "
             "Implement server-side validation. Prevents invalid data and XSS risk.",
             "Medium", "High")
REC_SLOW = (3, "Performance",
            "Enable gzip/Brotli, use WebP images, add a CDN, "
            "defer non-critical JS, enable browser caching.", "High", "High")
REC_ALT = (4, "Accessibility",
           "Add descriptive alt attributes; use alt='' for decorative images.", "Low", "Medium")
REC_TITLES = (5, "SEO",
              "Every page needs a unique title (50–60 chars) and "
              "meta description (150–160 chars).", "Low", "Medium")
REC_VIEWPORT = (6, "Mobile",
                "Add <meta name='viewport' content='width=device-width, initial-scale=1'>.",
                "Low", "Medium")
REC_SERVER = (1, "Critical",
              "Check server logs; set up uptime monitoring and alerting.", "High", "High")
REC_CANONICAL = (7, "SEO",
                 "Prevents duplicate-content SEO penalties on paginated/filtered URLs.",
                 "Low", "Low")
REC_HTTPS = (8, "Security",
             "Ensure all pages use HTTPS. Add Strict-Transport-Security header. "
             "Check for mixed-content warnings.", "Medium", "High")
REC_HTTPS_TITLE = "Enforce HTTPS + HSTS Headers"
REC_MONITORING = (9, "Monitoring",
                  "Run Lighthouse CI on every deploy; schedule weekly broken-link checks "
                  "and Pa11y accessibility scans.", "High", "High")
REC_MONITORING_TITLE = "Set Up Continuous Automated Testing"
REC_NONE = (1, "Info", "The site appears healthy.", "Low", "Low")
REC_NONE_TITLE = "No issues detected"

# --- fixed values: recurrence flags (issue type, risk, reason, frequency) ---
FLAG_BROKEN = ("Broken Link (404)", "High",
               "Links break whenever pages move without redirects.", "Check monthly")
FLAG_SLOW = ("Slow Page Load", "Medium",
             "Performance degrades as content grows.", "Re-test after every major release")

# --- fixed values: report wording ---
GOOD, NEEDS_WORK, POOR = "✅ Good", "⚠️ Needs Work", "❌ Poor"
NEEDS_WORK_CATEGORY = "⚠️ Needs work"
SMALL_SAMPLE_TEXT, ENOUGH_SAMPLE_TEXT = "⚠️ n<5", "✅ OK"
SMALL_SAMPLE_BELOW = 5
EXPORT_COLUMNS = ["module", "issue_type", "severity", "status", "occurrences",
                  "fix_time_hours", "description", "source", "page_url"]
LISTING_COLUMNS = [
    ("module", "Module"), ("issue_type", "Issue Type"), ("severity", "Severity"),
    ("status", "Status"), ("occurrences", "Occurrences"),
    ("fix_time_hours", "Est. Fix Time (h)"), ("description", "Description"),
    ("source", "Data Source"),
]
NOT_KNOWN = "n/a"
SUMMARY_MEANINGS = [
    ("Site URL", "The starting URL the crawler used"),
    ("Pages Crawled", "Unique pages visited"),
    ("Modules Detected", "Feature areas detected from URL patterns (e.g. /blog, /checkout)"),
    ("Total Issues", "Total problems found and recorded across all crawled pages"),
    ("Broken / Error Links", "Links whose server returned 4xx / 5xx or could not be reached"),
    ("External Links Checked", "Off-site links that were checked"),
    ("Crawl Duration", "Total wall-clock time to complete the crawl"),
    ("robots.txt Respected", "If Yes, pages blocked by robots.txt were skipped"),
]
