"""Word lists, hosts and patterns that results depend on."""

from __future__ import annotations

#: Synonyms (English and Chinese) and the standard INCI name of each; of equal keys the first counts.
SYNONYMS = [
    ("water", "Aqua"),
    ("aqua", "Aqua"),
    ("eau", "Aqua"),
    ("purified water", "Aqua"),
    ("deionized water", "Aqua"),
    ("de-ionized water", "Aqua"),
    ("water/aqua/eau", "Aqua"),
    ("water aqua eau", "Aqua"),
    ("aqua/water/eau", "Aqua"),
    ("aqua water eau", "Aqua"),
    ("水", "Aqua"),
    ("纯水", "Aqua"),
    ("去离子水", "Aqua"),
    ("纯净水", "Aqua"),
    ("alcohol", "Alcohol"),
    ("ethanol", "Alcohol"),
    ("变性乙醇", "Alcohol Denat."),
    ("alcohol denat.", "Alcohol Denat."),
    ("alcohol denat", "Alcohol Denat."),
    ("denatured alcohol", "Alcohol Denat."),
    ("sd alcohol 40-b", "Alcohol Denat."),
    ("乙醇", "Alcohol"),
    ("异丙醇", "Isopropyl Alcohol"),
    ("isopropyl alcohol", "Isopropyl Alcohol"),
    ("丙二醇", "Propylene Glycol"),
    ("propylene glycol", "Propylene Glycol"),
    ("丁二醇", "Butylene Glycol"),
    ("butylene glycol", "Butylene Glycol"),
    ("戊二醇", "Pentylene Glycol"),
    ("pentylene glycol", "Pentylene Glycol"),
    ("propanediol", "Propanediol"),
    ("1,3-propanediol", "Propanediol"),
    ("1,2-hexanediol", "1,2-Hexanediol"),
    ("1,2 hexanediol", "1,2-Hexanediol"),
    ("hexanediol", "1,2-Hexanediol"),
    ("dimethyl isosorbide", "Dimethyl Isosorbide"),
    ("乙氧基二甘醇", "Ethoxydiglycol"),
    ("ethoxydiglycol", "Ethoxydiglycol"),
    ("甘油", "Glycerin"),
    ("glycerin", "Glycerin"),
    ("glycerol", "Glycerin"),
    ("betaine", "Betaine"),
    ("甜菜碱", "Betaine"),
    ("sodium pca", "Sodium PCA"),
    ("zinc pca", "Zinc PCA"),
    ("尿素", "Urea"),
    ("urea", "Urea"),
    ("泛醇", "Panthenol"),
    ("panthenol", "Panthenol"),
    ("allantoin", "Allantoin"),
    ("尿囊素", "Allantoin"),
    ("烟酰胺", "Niacinamide"),
    ("niacinamide", "Niacinamide"),
    ("salicylic acid", "Salicylic Acid"),
    ("水杨酸", "Salicylic Acid"),
    ("glycolic acid", "Glycolic Acid"),
    ("乙醇酸", "Glycolic Acid"),
    ("lactic acid", "Lactic Acid"),
    ("乳酸", "Lactic Acid"),
    ("citric acid", "Citric Acid"),
    ("柠檬酸", "Citric Acid"),
    ("ascorbic acid", "Ascorbic Acid"),
    ("抗坏血酸", "Ascorbic Acid"),
    ("tocopherol", "Tocopherol"),
    ("retinol", "Retinol"),
    ("视黄醇", "Retinol"),
    ("retinyl palmitate", "Retinyl Palmitate"),
    ("视黄醇棕榈酸酯", "Retinyl Palmitate"),
    ("azelaic acid", "Azelaic Acid"),
    ("壬二酸", "Azelaic Acid"),
    ("tranexamic acid", "Tranexamic Acid"),
    ("传明酸", "Tranexamic Acid"),
    ("alpha-arbutin", "Alpha-Arbutin"),
    ("alpha arbutin", "Alpha-Arbutin"),
    ("熊果苷", "Arbutin"),
    ("arbutin", "Arbutin"),
    ("hyaluronic acid", "Hyaluronic Acid"),
    ("透明质酸", "Hyaluronic Acid"),
    ("玻尿酸", "Hyaluronic Acid"),
    ("sodium hyaluronate", "Sodium Hyaluronate"),
    ("透明质酸钠", "Sodium Hyaluronate"),
    ("sodium laureth sulfate", "Sodium Laureth Sulfate"),
    ("sodium lauryl sulfate", "Sodium Lauryl Sulfate"),
    ("椰油酰胺丙基甜菜碱", "Cocamidopropyl Betaine"),
    ("cocamidopropyl betaine", "Cocamidopropyl Betaine"),
    ("decyl glucoside", "Decyl Glucoside"),
    ("coco-glucoside", "Coco-Glucoside"),
    ("coco glucoside", "Coco-Glucoside"),
    ("sodium cocoyl isethionate", "Sodium Cocoyl Isethionate"),
    ("sodium cocoyl glutamate", "Sodium Cocoyl Glutamate"),
    ("disodium cocoyl glutamate", "Disodium Cocoyl Glutamate"),
    ("sodium lauroyl sarcosinate", "Sodium Lauroyl Sarcosinate"),
    ("caprylic/capric triglyceride", "Caprylic/Capric Triglyceride"),
    ("caprylic capric triglyceride", "Caprylic/Capric Triglyceride"),
    ("角鲨烷", "Squalane"),
    ("squalane", "Squalane"),
    ("dimethicone", "Dimethicone"),
    ("聚二甲基硅氧烷", "Dimethicone"),
    ("isopropyl myristate", "Isopropyl Myristate"),
    ("isopropyl palmitate", "Isopropyl Palmitate"),
    ("cetearyl alcohol", "Cetearyl Alcohol"),
    ("cetyl alcohol", "Cetyl Alcohol"),
    ("stearyl alcohol", "Stearyl Alcohol"),
    ("glyceryl stearate", "Glyceryl Stearate"),
    ("peg-100 stearate", "PEG-100 Stearate"),
    ("polysorbate 20", "Polysorbate 20"),
    ("polysorbate 60", "Polysorbate 60"),
    ("lecithin", "Lecithin"),
    ("carbomer", "Carbomer"),
    ("卡波姆", "Carbomer"),
    ("xanthan gum", "Xanthan Gum"),
    ("黄原胶", "Xanthan Gum"),
    ("hydroxyethylcellulose", "Hydroxyethylcellulose"),
    ("羟乙基纤维素", "Hydroxyethylcellulose"),
    ("sodium chloride", "Sodium Chloride"),
    ("氯化钠", "Sodium Chloride"),
    ("acrylates/c10-30 alkyl acrylate crosspolymer", "Acrylates/C10-30 Alkyl Acrylate Crosspolymer"),
    ("acrylates c10-30 alkyl acrylate crosspolymer", "Acrylates/C10-30 Alkyl Acrylate Crosspolymer"),
    ("disodium edta", "Disodium EDTA"),
    ("乙二胺四乙酸二钠", "Disodium EDTA"),
    ("phenoxyethanol", "Phenoxyethanol"),
    ("苯氧乙醇", "Phenoxyethanol"),
    ("ethylhexylglycerin", "Ethylhexylglycerin"),
    ("辛甘醇", "Ethylhexylglycerin"),
    ("chlorphenesin", "Chlorphenesin"),
    ("对羟基苯甲酸甲酯", "Methylparaben"),
    ("methylparaben", "Methylparaben"),
    ("propylparaben", "Propylparaben"),
    ("对羟基苯甲酸丙酯", "Propylparaben"),
    ("potassium sorbate", "Potassium Sorbate"),
    ("sodium benzoate", "Sodium Benzoate"),
    ("dehydroacetic acid", "Dehydroacetic Acid"),
    ("benzyl alcohol", "Benzyl Alcohol"),
    ("bht", "BHT"),
    ("butylated hydroxytoluene", "BHT"),
    ("fragrance", "Parfum"),
    ("parfum", "Parfum"),
    ("香精", "Parfum"),
    ("limonene", "Limonene"),
    ("linalool", "Linalool"),
    ("citral", "Citral"),
    ("geraniol", "Geraniol"),
    ("coumarin", "Coumarin"),
    ("hydroxycitronellal", "Hydroxycitronellal"),
    ("citronellol", "Citronellol"),
    ("eugenol", "Eugenol"),
    ("benzyl salicylate", "Benzyl Salicylate"),
]

#: Texts that stand for no text at all.
BLANK_WORDS = ["nan", "none", "null", "n/a", "na"]
NO_SOURCE_PHRASES = ["see image", "see packaging", "see package", "see back", "refer to packaging", "not available", "详见包装", "见包装", "见外包装", "见图片", "请见包装"]

#: Label and noise patterns of the ingredient parser, with the note each leaves.
LABEL_EN = r"(?i)^\s*(?:full\s+ingredients?\s+list|ingredient\s+list|ingredients?\s+list|ingredients?|inci\s+list|inci)\s*[:：]\s*"
LABEL_ZH = r"^\s*(?:全成分|成分|配料|配方)\s*[:：]\s*"
ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"
TRUNCATED = r"(?i)(?:\b(?:and|&)\b\s*(?:\.{3,}|…)?\s*$|\betc\.?\s*$)"
UI_PHRASES = r"(?i)(read\s+more(?:\s+on\s+how\s+to\s+read\s+an\s+ingredient\s+list)?|read\s+less|show\s+more|show\s+less|see\s+more|see\s+less|view\s+full\s+list|click\s+here|see\s+text|show\s+all\s+ingredients(?:\s+by\s+function)?|ingredients?\s+by\s+function|how\s+to\s+read\s+an\s+ingredient\s+list)"
NOISE_STEPS = [
    (ZERO_WIDTH, "", "Removed zero-width spaces"),
    (r"(?i)https?://[^\s)]+", " ", "Stripped URL(s)"),
    (r"(^|[\s,;，；])#[A-Za-z0-9][A-Za-z0-9_-]{0,40}", "$1", "Removed marketing hashtag(s)"),
    (r"(?i)\[\s*(?:more|less)\s*\]", " ", "Removed UI bracket token(s)"),
    (UI_PHRASES, " ", "Removed UI phrase(s)"),
    (TRUNCATED, "", "Removed truncation ending"),
    (r"\.{3,}|…+", " ", "Removed ellipsis artifact(s)"),
    (TRUNCATED, "", "Removed truncation ending"),
]

#: The block cleaner's UI phrases, its disclaimer, and tokens that make a text look like ingredients.
BLOCK_PHRASES = ["read more", "show more", "view full list", "view more", "see more", "click here", "see text", "see image", "back to top", "back"]
DISCLAIMER = r"(?i)dermalogica\s+is\s+dedicated\s+to\s+maintaining\s+the\s+accuracy\s+of\s+the\s+ingredient\s+lists.*$"
COMMON_TOKENS = ["water", "aqua", "glycerin", "alcohol", "fragrance", "parfum", "sodium", "citric", "acid", "ethanol", "乙醇", "甘油", "水"]
INCI_WORDS = r"(?i)\b(extract|oil|acid|oxide|glycol|glyceryl|triglyceride|tocopherol|ceramide|hyaluronate|dimethicone|polymer|parfum|phenoxyethanol|capry|ci\s?[0-9]{4,5}|water|aqua|sodium)\b"
CODE_SIGNS = '(?i)self\\.__next_f\\.push|__NEXT_DATA__|\\bwebpack\\b|\\bfunction\\s*\\(|\\bvar\\s+\\w+|\\bconst\\s+\\w+|\\blet\\s+\\w+|=>|\\bwindow\\.|\\bdocument\\.|"assetsUrl"|"buildId"|"pageProps"'

#: Audit word lists, patterns and hosts.
STOP_WORDS = ["with", "from", "your", "this", "that", "serum", "cream", "lotion", "cleanser", "treatment", "solution", "set", "kit", "gift", "card", "size", "travel"]
MARKETING = r"(?i)(experience\s+the\s+ultimate\s+luxury|how\s+to\s+use|for\s+best\s+results|clinically\s+proven|discover|daily\s+use|apply\s+(?:daily|morning|evening)|white\s+cast|hydrates?|protects?)"
REVIEW_NOTE = r"(?i)(removed|strip(?:ped)?|truncat|ui|artifact|noise|cleanup|boilerplate|marketing|label\s+prefix)"
RETAILERS = ["sephora.", "ulta.", "amazon.", "lookfantastic.", "cultbeauty.", "douglas.", "strawberrynet."]
THIRD_PARTIES = ["wikipedia.org", "incidecoder.com", "cosdna.com", "skincarisma.com"]
OFFICIAL_HOSTS = [("olehenriksen", "olehenriksen.com"), ("dermalogica", "dermalogica.com"), ("pixi", "pixibeauty.com"), ("pixi beauty", "pixibeauty.com")]

#: URL patterns of discovery.
TRACKING_KEY = r"(?i)^(utm_|fbclid$|gclid$|mc_|_ga$|_gl$|ref$|source$)"
STATIC_FILE = r"(?i)\.(?:css|js|mjs|map|png|jpe?g|gif|webp|svg|ico|pdf|xml|txt|woff2?|ttf|eot|otf|mp3|wav|mp4|webm|zip|gz|tar|json)(?:$|[?#])"
NEGATIVE_PATH = r"(?i)(?:^|/)(?:c|collections?|collection|category|catalogsearch|search|cart|account|customer|blog|blogs|pages?|faq|privacy|terms|wishlist|gift(?:ing)?|store-locator|customer-service|all-products|appointments?|booking|online-booking|locations?)(?:/|$)"
CARE_WORDS = r"(?i)serum|cream|cleanser|mask|oil|toner|moisturizer|sunscreen|spf|treatment|body|eye|lip|gel"
PRICE_SIGN = r"(?i)[$€£¥]\s?[0-9]|price(?:currency)?|sale price|from\s+[$€£¥]"
CATEGORY_WORDS = r"(?i)\b(shop|bestsellers|skincare|haircare|bodycare|fragrance|makeup|collections?)\b"
MARKET_WORDS = {"US": ["usa", "united states", "us"], "EU-DE": ["germany", "deutschland", "de"], "SG": ["singapore", "sg"], "JP": ["japan", "jp", "日本"]}

#: The markets: id, country, currency, locale.
MARKETS = [("US", "US", "USD", "en-US"), ("EU-DE", "DE", "EUR", "de-DE"), ("SG", "SG", "SGD", "en-SG"), ("JP", "JP", "JPY", "ja-JP")]

#: Words that speak for a product page or a link to one.
SHOP_WORDS = "(?i)add to cart|buy now|quick shop|learn more|shop now|details"
STOCK_WORDS = "(?i)in stock|out of stock|shade|size"
BUY_WORDS = "(?i)add to cart|buy now|quick shop|notify me"
PRODUCT_TYPE = r'(?i)"@type"\s*:\s*(?:"product"|\[[^\]]*"product")'
PRODUCT_META = "(?i)meta[^>]+property=[\"']og:type[\"'][^>]+content=[\"']product[\"']"

#: What pages of bot defences say, in lower case.
CLOUDFLARE_SIGNS = "just a moment|performing security verification|attention required|verify you are human|ray id|challenge-platform|please enable javascript and cookies"
CLOUDFLARE_WORDS = "cloudflare|challenge|captcha|security verification|verify you are human"
AKAMAI_SIGNS = "_abck|bm_sz|ak_bmsc"
AKAMAI_WORDS = "access denied|reference #|bot manager|akamai"
PERIMETERX_SIGNS = "_px|perimeterx|press & hold|human verification|px-captcha"
PERIMETERX_WORDS = "press & hold|human verification|captcha"
BLOCK_WORDS = "captcha|bot|challenge|security verification"

#: What block cleaning takes out besides BLOCK_PHRASES: links, hash tags, and trailing or filling words, in order.
BLOCK_LINK, BLOCK_TAG = r"(?i)https?://\S+", r"(^|\s)#[\w-]+"
BLOCK_FILLING = (r"(?i)\[\s*more\s*\]", r"(\.{3,}|…)", r"(?i)\b(and|&)\s*$", r"(?i)\betc\.?\s*$")

#: Labels at the start of a block, and labels anywhere in it, in English and Chinese.
BLOCK_LABEL_EN, BLOCK_LABEL_ZH = r"(?i)^(ingredients?|inci)\s*[:：]\s*", r"^(全成分|成分|配料|配方)\s*[:：]\s*"
INNER_LABEL_EN, INNER_LABEL_ZH = r"(?i)(?:ingredients?|inci)\s*[:：]\s*", r"(?:全成分|成分|配料|配方)\s*[:：]\s*"

#: A run of five Latin items or more, and the word that may stand before a list.
LATIN_RUN = r"([A-Za-z0-9][A-Za-z0-9()/&+.'’ -]*(?:,\s*[A-Za-z0-9][A-Za-z0-9()/&+.'’ -]*){4,})"
LIST_WORD = r"(?i)^ingredients?\s+"

#: What shows that a text tells more than an overview does.
EXPANDED_TEXT = r"(?i)\bthis set includes\b|\bproduct details\b|\n|•|\bto use\b"

#: Sizes and kits at the end of a product's name, which are no shades.
SIZE_HINT = r"(?i)\b(oz|ml|patches?|refill|kit|set|duo|trio|collection)\b|[0-9]"
