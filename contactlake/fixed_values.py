"""Fixed values.

Everything in this module is a fixed value: word lists, domain lists, lookup
tables, limits and patterns that decide the results and therefore have to be
exactly these.  They are defaults only; each operator takes its list as a
parameter, so another country or niche means passing other lists.
"""

# --- limits -----------------------------------------------------------------
MAX_EXPORT_PHONES = 6
PHONES_OVERFLOW_THRESHOLD = 10
PHONES_OVERFLOW_MOBILE_MAX = 10
HITS_PER_QUERY_MIN = 100
DEFAULT_MAX_SITES = 50
MIN_SITES, MAX_SITES = 10, 200
MIN_DEPTH, MAX_DEPTH = 1, 5
DEFAULT_DEPTH = 2
GUIDE_MARK = "kudagid"
BRIEF_SOURCES = ("serp", "site", "catalog")
PAGE_SIZE = 50

# --- phone patterns (Java regex; WHITE_SPACE is the Unicode white space set) ---
WHITE_SPACE = r"\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTEXT_WORDS = ("телефон", "тел\\.", "звоните", "контакт", "call", "phone")
MESSENGER_LINKS = r"(?i)(wa\.me|whatsapp|t\.me|telegram|viber|max\.ru)"
FOOTER_HINTS = r"(?iu)(footer|podval|bottom[-_]?bar|site[-_]?bottom|copyright|подвал|футер|нижн)"
PHONE_DATA_ATTRS = ("data-phone", "data-tel", "data-telephone", "data-href")

SOURCE_RANK = {
    "header": 0, "nav": 1, "tel": 2, "callto": 2, "footer": 3, "header-class": 4,
    "data-attr": 5, "json-ld": 6, "meta": 7, "context": 8, "text": 9, "html": 10,
}

# --- crawl paths and link hints ----------------------------------------------
CONTACT_PATHS = ("/contacts", "/contact", "/kontakty", "/kontakt")
ABOUT_PATHS = ("/o-kompanii", "/o-nas", "/about", "/about-us")
PATH_HINTS = r"(?iu)(contact|kontakt|контакт|about|o-nas|o_nas|kompan|company|svyaz)"
SECTION_PATHS = (
    "/uslugi", "/services", "/service", "/catalog", "/products", "/produktsiya",
    "/resheniya", "/solutions",
)
SECTION_HINTS = (
    r"(?iuU)(услуг|service|catalog|каталог|продукт|product|решени|solution|о\s*компан|about|"
    r"направлен|деятельност|поставк|аренд|производств|оборудован|техник)"
)
MENU_CLASS_WORDS = ("nav", "menu", "footer", "header", "cookie", "modal")
SITE_ZONES = ("ru", "com", "рф", "org", "net", "biz")
PARKING_PHRASES = ("domain is for sale", "parked", "купить домен", "coming soon")

# --- domain lists -------------------------------------------------------------
AGGREGATOR_DOMAINS = (
    "avito.ru", "2gis.ru", "yell.ru", "pulscen.ru", "kudago.com", "yandex.ru", "ya.ru",
    "google.com", "google.ru", "wikipedia.org", "youtube.com", "youtu.be", "vk.com",
    "t.me", "telegram.me", "telegram.org", "dzen.ru", "facebook.com", "instagram.com",
    "ok.ru", "mail.ru", "ozon.ru", "wildberries.ru",
)
CATALOG_DOMAINS = ("kudagid.ru", "2gis.ru")
JUNK_DOMAINS = (
    "klerk.ru", "vc.ru", "habr.com", "dtf.ru", "cyberleninka.ru", "cossa.ru",
    "lifehacker.ru", "sberbank.ru", "tbank.ru", "banki.ru", "consultant.ru",
    "kontur.ru", "bitrix24.ru", "moedelo.org", "sbercrm.com", "envybox.io",
    "advantshop.net", "aspro.cloud", "aspro.ru", "vtiger.com", "jaycopilot.com",
    "allo.tochka.com", "kdelu.vtb.ru", "journal.sovcombank.ru", "zakonrf.info",
    "advgazeta.ru", "kp.ru", "business.ru", "upr.ru", "assistentus.ru",
    "audit-it.ru", "kpfu.ru", "kubsu.ru", "lib.rosdiplom.ru", "elib.utmn.ru",
    "imi-samara.ru", "advertisingforum.ru", "tjournal.ru", "pikabu.ru",
    "lenta.ru", "rbc.ru", "mk.ru", "ria.ru", "interfax.ru",
)
INFO_HOST_PARTS = (
    "habr.com", "vc.ru", "opennet.ru", "wikipedia.org", "tjournal.ru",
    "reddit.com", "pikabu.ru", "lenta.ru", "rbc.ru",
)
STANDARD_EXCLUDE = (
    "avito.ru", "2gis.ru", "yell.ru", "pulscen.ru", "wikipedia.org", "youtube.com",
    "ozon.ru", "wildberries.ru", "market.yandex.ru",
)
SEED_DOMAINS = (
    "best-opalubka.ru", "avant-opalubka.ru", "arsipro.ru", "opalubka-trade.ru",
    "faneratorg.ru", "prosto-monolit.ru", "myopalubka.ru", "egds.ru", "opalubkaset.ru",
    "renta76.ru", "arendaopalubki52.ru", "gora-nn.ru",
)
DEFAULT_QUERIES = (
    "аренда опалубки", "аренда крупнощитовой опалубки", "аренда мелкощитовой опалубки",
    "аренда опалубки Москва", "аренда опалубки Щелково", "аренда опалубки Ярославль",
    "аренда опалубки Владимир", "аренда опалубки Нижний Новгород",
)

# --- result classification -----------------------------------------------------
MEDIA_HOSTS = (
    r"(?i)(^|\.)((mk|rg|news|gazeta|vesti|press)\.[a-z]{2,3}|"
    r"73\.ru|66\.ru|59\.ru|161\.ru|e1\.ru|ngs\.ru)"
)
EDU_HOSTS = r"(?i)(\.edu\.|\.ac\.|univer|kpfu\.|kubsu\.|utmn\.|sfedu\.|hse\.ru|msu\.ru)"
ARTICLE_TEXT = (
    r"(?iu)(что такое|как рассчитать|как взыскать|статьи о|всё про|"
    r"университет|репозитори|дипломн|курсовых|научн.*стат|киберленинка|"
    r"законодательств|консультантплюс|национальный рекламный форум|"
    r"портал банка|журнал для|лайфхакер|игры, кино|публикации /|"
    r"адвокатская газета|арбитражная практика|бухгалтерский учет|"
    r"финансовой грамотности|новости россии)"
)
COMMERCIAL_SIGNALS = (
    "агентств", "аутсорс", "лидоген", "лидген", "отдел продаж", "колл-центр",
    "колл центр", "телемарк", "обзвон", "генерац", " лид", "b2b", "под ключ",
    "заказать", "услуг", "консалт", "аутрич", "холодн", "performance",
)
QUERY_SYNONYMS = (
    ("лидоген", ("лидоген", "лидген", "лиды", "лид ", "lead", "заявк", "спрос")),
    ("лидген", ("лидоген", "лидген", "лиды", "заявк")),
    ("b2b", ("b2b", "бизнес", "компан", "корпорат")),
    ("колл", ("колл", "call", "обзвон", "телемарк", "контакт-центр", "контакт центр")),
    ("обзвон", ("обзвон", "колл", "call", "телемарк")),
    ("аутсорс", ("аутсорс", "аутстафф", "удаленн", "удалённ")),
    ("продаж", ("продаж", "sales", "отдел продаж", "коммерч")),
    ("маркетинг", ("маркетинг", "продвижен", "реклам", "агентств")),
    ("опалуб", ("опалуб", "опалубк")),
)
NICHE_STOP_WORDS = (
    "аренда", "продажа", "москва", "область", "нижний", "новгород", "ярославль",
    "владимир", "щелково", "склад", "крупнощитовая", "мелкощитовая", "перекрытия",
    "колонны", "система", "услуги", "компания", "бизнеса", "под ключ",
)
NICHE_ROOT = "опалуб"

# --- locale codes, in match order -----------------------------------------------
LOCALE_CODES = (
    ("москва", 213), ("московск", 1), ("ярослав", 16), ("владимир", 192),
    ("нижегород", 47), ("санкт-петербург", 2), ("спб", 2),
)

# --- labels ------------------------------------------------------------------------
STATUS_LABELS = {
    "done": "готово", "error": "ошибка", "stopped": "остановлен", "running": "идёт",
    "pending": "ожидание",
}
NO_OPERATOR = "не указан"
NO_LABEL = "—"
NO_REGION = "Без региона"
STATUS_EXCLUDED, STATUS_AGGREGATOR, STATUS_CANDIDATE = "исключён", "агрегатор", "кандидат"
STATUS_FOUND, STATUS_NO_PHONE = "найден", "без телефона"
SOURCE_SITE, SOURCE_SEARCH, SOURCE_CATALOG, SOURCE_GUIDE = "сайт", "SERP", "каталог", "KudaGid"
EXPORT_HEAD = ("Сайт", "Компания", "Регион")
EXPORT_PHONE = "Телефон"
EXPORT_TAIL = ("Источник", "Статус", "К определению")
EXPORT_MARK = "да"
EXPORT_MARKED_SUFFIX = "к-определению"
SEED_SNIPPET = "быстрый обход"
STEPS = ("analyze", "serp", "filter", "crawl", "catalog", "dedup")

# --- brief text labels -> field ------------------------------------------------------
BRIEF_LABELS = {
    "Кто запускает": "operatorName", "Клиент": "clientName", "Сайт клиента": "clientSite",
    "Ниша": "niche", "Режим регионов": "regionMode", "Регионы": "regions",
    "Поисковые запросы": "queries", "Исключить домены": "excludeDomains",
    "Фильтр телефонов": "phoneFilter", "Источники": "sources",
    "Проверка живого сайта": "checkAlive", "Макс. сайтов": "maxSites",
    "Глубина обхода": "crawlDepth", "Пауза между запросами (мс)": "requestDelayMs",
    "Прокси": "useProxy",
}
YES_WORDS = ("да", "yes", "true", "1", "on")
NO_WORDS = ("нет", "no", "false", "0", "off")

# --- fetch error classes: marker -> class ----------------------------------------------
TLS_MARKERS = (
    "certificate_verify_failed", "ssl:", "sslerror", "certificate verify failed",
    "ee certificate key too weak", "certificate has expired", "self signed certificate",
    "self-signed certificate",
)
TIMEOUT_NAMES = ("readtimeout", "connecttimeout", "writetimeout", "pooltimeout")

# --- regions: district id, name, short name, member regions ------------------------------
DISTRICTS = (
    ("cfo", "Центральный федеральный округ", "ЦФО", (
        "Белгородская область", "Брянская область", "Владимирская область",
        "Воронежская область", "Ивановская область", "Калужская область",
        "Костромская область", "Курская область", "Липецкая область", "Москва",
        "Московская область", "Орловская область", "Рязанская область",
        "Смоленская область", "Тамбовская область", "Тверская область",
        "Тульская область", "Ярославская область")),
    ("szfo", "Северо-Западный федеральный округ", "СЗФО", (
        "Архангельская область", "Вологодская область", "Калининградская область",
        "Ленинградская область", "Мурманская область", "Ненецкий автономный округ",
        "Новгородская область", "Псковская область", "Республика Карелия",
        "Республика Коми", "Санкт-Петербург")),
    ("ufo", "Южный федеральный округ", "ЮФО", (
        "Астраханская область", "Волгоградская область", "Донецкая Народная Республика",
        "Запорожская область", "Краснодарский край", "Луганская Народная Республика",
        "Республика Адыгея", "Республика Калмыкия", "Республика Крым",
        "Ростовская область", "Севастополь", "Херсонская область")),
    ("skfo", "Северо-Кавказский федеральный округ", "СКФО", (
        "Кабардино-Балкарская Республика", "Карачаево-Черкесская Республика",
        "Республика Дагестан", "Республика Ингушетия",
        "Республика Северная Осетия — Алания", "Ставропольский край",
        "Чеченская Республика")),
    ("pfo", "Приволжский федеральный округ", "ПФО", (
        "Кировская область", "Нижегородская область", "Оренбургская область",
        "Пензенская область", "Пермский край", "Республика Башкортостан",
        "Республика Марий Эл", "Республика Мордовия", "Республика Татарстан",
        "Самарская область", "Саратовская область", "Удмуртская Республика",
        "Ульяновская область", "Чувашская Республика")),
    ("urfo", "Уральский федеральный округ", "УрФО", (
        "Курганская область", "Свердловская область", "Тюменская область",
        "Ханты-Мансийский автономный округ — Югра", "Челябинская область",
        "Ямало-Ненецкий автономный округ")),
    ("sfo", "Сибирский федеральный округ", "СФО", (
        "Алтайский край", "Иркутская область", "Кемеровская область — Кузбасс",
        "Красноярский край", "Новосибирская область", "Омская область",
        "Республика Алтай", "Республика Тыва", "Республика Хакасия", "Томская область")),
    ("dfo", "Дальневосточный федеральный округ", "ДФО", (
        "Амурская область", "Еврейская автономная область", "Забайкальский край",
        "Камчатский край", "Магаданская область", "Приморский край",
        "Республика Бурятия", "Республика Саха (Якутия)", "Сахалинская область",
        "Хабаровский край", "Чукотский автономный округ")),
)
# short labels that do not follow the "область" -> "обл." rule
REGION_LABELS = {
    "Москва": "г. Москва", "Санкт-Петербург": "г. Санкт-Петербург",
    "Севастополь": "г. Севастополь", "Ненецкий автономный округ": "Ненецкий АО",
    "Ханты-Мансийский автономный округ — Югра": "ХМАО — Югра",
    "Ямало-Ненецкий автономный округ": "Ямало-Ненецкий АО",
    "Чукотский автономный округ": "Чукотский АО",
    "Еврейская автономная область": "Еврейская АО",
    "Донецкая Народная Республика": "ДНР", "Луганская Народная Республика": "ЛНР",
}
REGION_ALIASES = {
    "еврейская автономная область": ("еао", "еврейск", "биробиджан"),
    "ненецкий автономный округ": ("ненец", "нао"),
    "ханты-мансийский автономный округ — югра": ("югра", "хмао", "ханты", "сургут"),
    "чукотский автономный округ": ("чукот", "анадыр"),
    "ямало-ненецкий автономный округ": ("янао", "ямал", "салехард"),
    "москва": ("москв",),
    "санкт-петербург": ("петербург", "спб"),
}
REGION_SUFFIXES = (
    "ская область", "ский край", " автономная область", " автономный округ",
    "ская республика", " народная республика",
)

# --- site profile: model signals in tie order -----------------------------------------------
MODEL_SIGNALS = (
    ("goods_rental", ("аренда ", "прокат ", "в сутки", "за смену", "посуточн", "арендовать")),
    ("goods_sales", ("купить ", "продажа ", "каталог", "цена ", "в наличии", "корзин",
                     "заказать ", "оптом", "дилер", "поставк")),
    ("manufacturing", ("производств", "завод ", "изготовлен", "цех ", "выпускаем", "фабрик")),
    ("construction_services", ("под ключ", "монтаж ", "строительств", "проектирован",
                               "смета ", "генподряд")),
    ("b2b_services", ("b2b", "для бизнеса", "для компан", "отдел продаж", "лидоген", "лиды",
                      "выручк", "прибыл", "консалт", "аутсорс", "воронк", "спрос", "crm",
                      "маркетинг", "обзвон", "квалификац")),
    ("cleaning_equipment", ("поломоечн", "подметальн", "уборочн", "клининг", "мойк",
                            "пылесос", "складск", "погрузочн")),
    ("local_services", ("выезд", "на дом", "мастер ", "вызов ", "услуги в ", "обслуживание ")),
)
MODEL_LABELS = {
    "goods_rental": "аренда оборудования/товаров",
    "goods_sales": "продажа товаров",
    "manufacturing": "производство",
    "construction_services": "строительные услуги",
    "b2b_services": "B2B-услуги для бизнеса",
    "cleaning_equipment": "промышленная техника и оборудование",
    "local_services": "локальные услуги",
    "unknown": "услуги и решения для клиентов",
}
B2B_SIGNALS = ("b2b", "для бизнеса", "для компан", "юрлиц", "оптом")
B2C_SIGNALS = ("для дома", "частных", "физлиц", "семьи")
KEYWORD_STOP_WORDS = (
    "главная", "контакты", "компания", "подробнее", "читать", "далее", "меню",
    "сайт", "страница", "раздел", "блок", "кнопка", "форма", "политика",
    "copyright", "права", "защищены", "согласие", "персональных",
)
GEO_CITIES = (
    ("москва", "Москва"), ("московск", "Москва"), ("москве", "Москва"),
    ("щелково", "Щелково"), ("ярославл", "Ярославль"), ("владимир", "Владимир"),
    ("нижний новгород", "Нижний Новгород"), ("санкт-петербург", "Санкт-Петербург"),
    ("петербург", "Санкт-Петербург"), ("казань", "Казань"),
    ("екатеринбург", "Екатеринбург"), ("новосибирск", "Новосибирск"),
)

# --- phrase judging -----------------------------------------------------------------------------
SKIP_PHRASE = (
    r"(?iu)^(главная|каталог|контакты|о компании|о нас|услуги|портфолио|производство|"
    r"новости|статьи|акции|проекты|скачать|отзывы|доставка|оплата|ещё|меню|"
    r"подробнее|узнать стоимость|оставить заявку|заказать|получить консультацию|"
    r"заказать звонок|отправить|согласен|принимаю|загрузка|все права|copyright|"
    r"сертификат|лицензи|реализованн.*проект|"
    r"для кого|кто за этим стоит|форматы старта|физика прибыли|технологии|взаимодействие|"
    r"команда|faq|связаться|результаты пилотов|"
    r"[0-9]{1,3}\s*м²|[0-9]+$|0[0-9]$)$"
)
SECTION_JUNK = (
    r"(?iu)(кто за этим|"
    r"[0-9]+\s*проблем.*[0-9]+\s*реш|"
    r"результат.*пилот|"
    r"^решение\s*:|^проблема\s*:|"
    r"система прибыли\s*:\s*[0-9]+|"
    r":\s*[0-9]+\s*этап|"
    r"^[0-9]+\s*проблем|"
    r"^[0-9]+\s*этап)"
)
LABEL_PREFIX = r"(?iu)^(?:решение|проблема|этап)\s*:\s*"
PROMO = r"(?iu)акци[!]|скидк|%|специальн.*цен|оформлении.*месяц|б/у\s|рассрочк"
TRIM_MARKS = "·|-—–:;,."
SERVICE_HINTS = (
    "аренда", "продаж", "опалуб", "каркас", "дом", "ангар", "строитель",
    "монтаж", "производ", "оборудован", "металл", "бетон", "опт",
    "лидоген", "b2b", "маркетинг", "клиент", "воронк", "спрос",
    "прибыл", "консалт", "аутсорс", "crm", "лид", "обзвон", "выручк",
    "машин", "станк", "спецодеж", "кровл", "фасад", "дистриб",
    "усилен", "углеволок", "армирован", "aeo", "jtbd",
)
QUERY_STARTERS = (
    "аренда", "продаж", "купить", "строитель", "монтаж", "лидоген", "систем",
    "управлен", "привлечен", "аутсорс", "консалт", "маркетинг", "обслужив",
    "изготовлен", "доставк", "ремонт", "проектирован", "обследован", "каркас",
    "опалуб", "ангар", "дом ", "усилен",
)
BAD_QUERY_START = (
    "производство", "завод", "результат", "результаты", "спроса", "решение",
    "проблема", "этап", "этапы", "пилот", "пилоты", "команда", "технологии",
)
PHRASE_STOP_WORDS = (
    "компания", "услуги", "подробнее", "контакты", "главная", "каталог", "новости",
    "статьи", "политика", "обработку", "персональных", "данных", "согласен",
    "принимаю", "отправить", "заявку", "заказать", "звонок", "смотреть", "разделы",
    "связаться", "вопросы", "загрузка", "home", "menu", "blog", "read", "more",
)
SECTION_WORDS = ("результат", "пилот", "этап", "проблем")
SECTION_EXCUSES = ("лидоген", "b2b", "прибыл", "спрос", "продаж", "маркетинг")
FOOTER_STOP = r"(?iuU)\s*(политика|инн|огrn|оферт|конфиденциаль|пользовательск|©|copyright)\b.*$"
COMPANY_PATTERNS = (
    r"(?iuU)(ООО\s+[«\"][^»\"]+[»\"])",
    r"(?iuU)(ООО\s+[A-Za-zА-Яа-яёЁ0-9\-«»\"'\s]{3,60})",
    r"(?iuU)©[^\n]{0,120}(ООО\s+[«\"][^»\"]+[»\"])",
    r"(?iuU)ИНН\s+[0-9]+\s+(ИП\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){1,2})",
    r"(?iuU)(ИП\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){1,2})",
)
COMPANY_FORMS = r"(?iuU)^(ООО|ИП|АО)\s"
BRAND_IMAGE_WORDS = r"(?iu)logo|icon|картин|image|banner"
BRAND_NAME_WORDS = r"(?iu)опалубка|строй|дом|клуб|инноватор"
BRAND_OF_COMPANY = r"(?iu)опалубка|домстрой"
COMPANY_FORM_WORD = "ооо"

# --- query templates: (model, {} = offering) and (trigger words, queries) --------------------------
GOODS_TEMPLATES = {
    "goods_rental": ("аренда {}", "{} аренда"),
    "goods_sales": ("купить {}", "{} цена", "{} оптом"),
    "manufacturing": ("производство {}", "{} завод", "изготовление {} на заказ"),
    "cleaning_equipment": ("купить {}", "{} поставщик", "промышленная {}"),
    "construction_services": ("{} под ключ", "услуги {}"),
}
GOODS_SKIP = {
    "goods_rental": r"^аренда",
    "goods_sales": r"^(купить|продажа)",
    "construction_services": r"под ключ",
}
B2B_TRIGGERS = (
    (("лидоген", "лид", "лиды", "заявк"),
     ("лидогенерация B2B", "аутсорсинг отдела продаж", "генерация лидов для бизнеса")),
    (("спрос", "привлечен", "клиент"), ("привлечение целевых клиентов B2B",)),
    (("прибыл", "выручк", "управлен"),
     ("управление прибылью компании", "система управления продажами")),
    (("обзвон", "call", "колл"), ("аутсорсинг телемаркетинга B2B",)),
    (("маркетинг", "реклам", "продвижен"), ("маркетинг для B2B компаний",)),
)
SERVICE_PREFIX = "услуги "
LOCAL_MODELS = ("goods_rental", "goods_sales", "construction_services", "local_services")
