"""Fixed values.

Every constant in this file (word lists, label sets, patterns, formats) is
part of the contract of the results: change one and rows change.  They are
kept together, in their natural order, and hold no logic.  Longer
vocabularies are parameters of ``DirectoryConfig`` instead.
"""

# ---- missing values and output ------------------------------------------
NOT_FOUND = "Not Found"
OUTPUT_COLUMNS = [
    "Company Name", "Contact Person", "Position", "State", "City",
    "Country", "Phone Number", "Email", "Website", "Products",
]

# ---- e-mail --------------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PLACEHOLDER_DOMAINS = ["example.com", "yourdomain.com", "domain.com", "test.com", "localhost"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp"]
RETINA_MARKS = ["@2x.", "@3x."]
ROLE_MAILBOXES = ["contact", "info", "sales", "support", "admin", "enquiry"]

# ---- phone ---------------------------------------------------------------
PHONE_LINE_WORDS = ["phone", "tel", "cell", "mob", "call us", "contact", "whatsapp", "telephone"]

# ---- places --------------------------------------------------------------
CITY_CLASSES = ["city", "locality", "town"]
CITY_WORDS = ["city", "town", "locality", "municipality", "village"]
STATE_CLASSES = ["state", "province", "region", "county"]
STATE_WORDS = ["state", "province", "region", "county", "district", "territory"]
ADDRESS_LINE_WORDS = ["phone", "tel:", "address:", "email:"]
CITY_LINE_COUNTRIES = [
    "South Africa", "Kenya", "Nigeria", "Ghana", "Egypt", "Morocco", "Algeria", "Namibia",
    "Botswana", "Zambia", "Zimbabwe", "Tanzania", "Uganda", "Ethiopia", "Angola", "Mozambique",
]
LABELLED_PLACE_PATTERN = r"\b{word}\s*[:.\-–—]\s*([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)"
CITY_LINE_PATTERN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*,\s*(?:{countries})"
PLACE_MAX_CHARS = 60

# ---- search results and URLs --------------------------------------------
SEARCH_DOMAINS = [
    "google.com", "google.co", "youtube.com", "accounts.google.com",
    "policies.google.com", "support.google.com", "maps.google.com",
]
SEARCH_HOME = "https://www.google.com"
SEARCH_SUFFIXES = [
    "manufacturer", "company", "business", "firm", "supplier",
    "distributor", "exporter", "vendor", "dealer",
]
SOCIAL_DOMAINS = ["facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com"]
SOCIAL_VISIT_PATTERN = r"(?:^|://)(?:www\.)?(?:facebook|twitter|x)\.com/"
RESULT_CLASSES = ["g", "tF2Cxc", "yuRUbf"]
UNKNOWN_TITLE = "Unknown"
GENERIC_TITLES = [
    "about", "about us", "products", "product", "packaging", "home", "home page", "contact",
    "contact us", "services", "our services", "overview", "company name", "our products",
    "all products", "categories", "shop", "store", "our company",
]
ABOUT_KEYWORDS = ["about", "company", "our story", "profile"]

# ---- relevance, shops, blocked pages ------------------------------------
MAKER_TERMS = ["manufacturer", "manufacturing", "production", "factory", "made in"]
CART_PATTERN = r"cart|checkout|add to|buy now"
GRID_CLASSES = ["product-grid", "item-grid", "catalog"]
BLOCKED_PHRASES = [
    "captcha", "unusual traffic", "verify you're human", "enter the characters",
    "i'm not a robot", "are you a robot", "sorry, please try again later",
    "our systems have detected unusual traffic",
    "this page could not be loaded automatically",
]

# ---- company names -------------------------------------------------------
DOMAIN_SKIP_LABELS = [
    "com", "co", "org", "net", "gov", "edu", "uk", "za", "in", "au", "ca", "de", "fr", "es",
    "it", "nl", "br", "jp", "cn", "kr", "ng", "ke", "eg", "ma", "tn", "gh", "tz", "ug", "zm",
    "zw", "mw", "na", "bw", "mz", "ao", "sz", "ls", "mg",
]
FALLBACK_SKIP_LABELS = ["com", "co", "org", "net", "gov", "edu", "uk", "za", "in", "au"]
STOCK_IMAGE_ALTS = [
    "logo", "company logo", "site logo", "brand", "home", "", "copyright", "picture", "photo",
    "image", "banner", "header", "footer", "icon", "avatar", "profile", "thumbnail",
    "logo mark", "brand logo", "buyer icon", "search icon", "menu", "user", "cart",
    "shopping cart", "logo image", "main logo", "site logo image",
]
TEMPLATE_PATTERN = r"\{\{.*?\}\}|\{%.*?%\}"
BARE_DOMAIN_PATTERN = r"(?:(?:https?:)?//)?(?:www\.)?[a-z0-9.-]+\.[a-z]{2,}"
COPYRIGHT_PATTERN = (
    r"(?:©|copyright)\s*(?:\d{4}\s*)?"
    r"([A-Z][A-Za-z0-9][A-Za-z0-9\s&.,'-]+?)"
    r"(?:\s*[,.]?\s*(?:All\s+[Rr]ights|Inc|Ltd|Pty|™|®|\d{4}))"
)

# ---- person names --------------------------------------------------------
NAME_PATTERN = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}"
NAME_SKIP_WORDS = [
    "And", "The", "For", "Of", "Our", "Us", "Today", "With", "Your", "This", "That", "From",
]
COMPANY_WORDS = [
    "Pvt", "Ltd", "GmbH", "Inc", "LLC", "Company", "Industries", "Corporation", "Corp",
    "Limited", "Healthcare", "Systems", "Solutions", "Supplies", "Services", "Products",
    "Product", "Equipment", "Technologies", "Enterprises", "Infrastructure", "Distribution",
    "Manufacturing", "Portfolio", "Business", "Network", "Supplier", "Suppliers",
    "Manufacturer", "Manufacturers", "Device", "Devices", "Instruments", "Health", "Estate",
    "Organization", "Platforms", "Meta",
]
NOISE_WORDS = [
    "And", "The", "For", "Of", "Our", "Us", "Today", "With", "Your", "This", "That", "From",
    "South", "North", "East", "West", "Central", "Supreme", "Medical", "Surgical", "Africa",
    "Industrial", "Cardiovascular", "Numbers", "Media", "Share", "Rights", "Contact",
    "Products", "Product", "Portfolio", "Healthcare", "Systems", "Solutions", "Supplies",
    "Services", "Equipment", "Technologies", "Enterprises", "Distribution", "Manufacturing",
    "Business", "Network", "Cookie", "Policy", "Select", "Page", "Home", "Returns", "Profile",
    "Overview", "Uniforms", "Accessories", "Login", "Register", "Sign", "Search", "Menu",
    "Navigation", "National", "International", "Regional", "Local", "Pvt", "Ltd", "GmbH",
    "Inc", "LLC", "Company", "Industries", "Corporation", "Corp", "Limited",
]
NOISE_SHARE = 0.4

# ---- roles ---------------------------------------------------------------
ROLE_TITLES_PATTERN = (
    r"CEO|President|Managing Director|Sales Manager|Marketing Manager|"
    r"Operations Manager|General Manager|Technical Manager|Production Manager|"
    r"Quality Manager|Director|Founder|Owner|Coordinator|Supervisor|Executive|"
    r"C\.E\.O\.|M\.D\.|VP|Vice\s*President|Head\s+of|Lead|Chief|Officer|"
    r"Engineer|Technician|Specialist|Analyst|Consultant|Representative|"
    r"Assistant|Associate|Manager|Superintendent|Administrator"
)
ROLE_CANONICAL = {
    "ceo": "CEO", "president": "President", "director": "Director", "founder": "Founder",
    "owner": "Owner", "coordinator": "Coordinator", "supervisor": "Supervisor",
    "executive": "Executive", "managing director": "Managing Director",
    "sales manager": "Sales Manager", "marketing manager": "Marketing Manager",
    "operations manager": "Operations Manager", "general manager": "General Manager",
    "technical manager": "Technical Manager", "production manager": "Production Manager",
    "quality manager": "Quality Manager", "c.e.o.": "CEO", "m.d.": "Managing Director",
    "vp": "VP", "vice president": "Vice President", "head of": "Head", "chief": "Chief",
    "officer": "Officer", "engineer": "Engineer", "technician": "Technician",
    "specialist": "Specialist", "analyst": "Analyst", "consultant": "Consultant",
    "representative": "Representative", "assistant": "Assistant", "associate": "Associate",
    "manager": "Manager", "superintendent": "Superintendent",
    "administrator": "Administrator", "lead": "Lead",
}
ROLE_LEAD_CHARS = ":-—–,;"
ROLE_MAX_CHARS = 60
TEAM_HEADINGS = [
    "our team", "team", "board of directors", "board members", "board", "management",
    "leadership", "our people", "key personnel", "executives", "management team",
    "executive team", "our staff", "organizational structure", "meet the team",
    "meet our team", "team members",
]
MEMBER_CLASS_PATTERN = r"team|member|person|staff|executive|board|profile|leadership|founder"
ROLE_CLASS_PATTERN = r"role|title|position|designation|job"
ROLE_SEPARATORS = ["—", "–", "-", "|"]

# Contextual name patterns, tried in this order; the last two carry a role.
PERSON_PATTERNS = [
    r"(?i:contact\s*(?:person|us|info|sales))[\s:]+\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
    r"(?i:sales\s*(?:contact|manager|director))[\s:]+\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
    r"(?i:managing\s*(?:director|partner))[\s:]+\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
    r"(?i:ceo|president|director|manager|founder|owner|coordinator)[\s:]+\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\s*[—–\-|]\s*"
    r"((?i:ceo|president|managing\s+director|director|manager|founder|owner|"
    r"coordinator|supervisor|executive|engineer|technician|specialist|analyst|"
    r"consultant|lead|head|chief|officer|partner|representative|assistant|associate)"
    r"(?:\s+(?:of|and|&|the|operations|sales|marketing|quality|production|technical|"
    r"general|finance|hr|rd|engineering|logistics|procurement|bd|customer|product|"
    r"design|manufacturing)){0,3})\b",
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\s*\(((?i:ceo|president|director|manager|"
    r"founder|owner|coordinator|supervisor|executive))\s*\)",
]

# ---- sample inputs (every list is a parameter) ---------------------------
SAMPLE_QUERIES = ["cargo bike workshop Denmark", "wheel builder Sweden", "bicycle parts wholesale Norway"]
SAMPLE_EXCLUDED_SITES = ["marketplace.", "classifieds.", "encyclopedia."]
SAMPLE_CATEGORIES = ["cargo bike", "wheel set", "brake pad", "inner tube", "bike"]
SAMPLE_COUNTRIES = ["Denmark", "Finland", "Iceland", "Norway", "Sweden"]
SAMPLE_COUNTRY_KEYWORDS = ["Country:", "Location:", "Address:", "Headquarters:", "Based in"]
SAMPLE_CONTACT_KEYWORDS = [
    "contact", "about", "company", "directory", "support", "reach", "locations",
]
SAMPLE_PHONE_PREFIXES = [
    "+213", "+244", "+229", "+267", "+226", "+257", "+238", "+237", "+236", "+235", "+269",
    "+243", "+242", "+253", "+20", "+240", "+291", "+268", "+251", "+241", "+220", "+233",
    "+224", "+245", "+225", "+254", "+266", "+231", "+218", "+261", "+265", "+223", "+222",
    "+230", "+212", "+258", "+264", "+227", "+234", "+250", "+239", "+221", "+248", "+232",
    "+252", "+27", "+211", "+249", "+255", "+228", "+216", "+256", "+260", "+263",
]
SAMPLE_PHONE_PATTERNS = [
    r"\+?\d{1,3}[\s-]?\d{2,4}[\s-]?\d{3,4}[\s-]?\d{3,4}",
    r"\d{3}[\s-]?\d{3}[\s-]?\d{4}",
    r"\b\d{7,15}\b",
]
SAMPLE_SHOP_INDICATORS = [
    "add to cart", "buy now", "shopping cart", "checkout", "add to basket", "store", "shop",
    "purchase", "order", "price", "payment", "shipping", "delivery", "ecommerce",
]
