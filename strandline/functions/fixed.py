"""Word lists, lookup tables, patterns and limits that results depend on, stated as they are.

Nothing is decided here; the modules that use a value say how.
"""

# Titles, claims, links.
PUBLISHER_SUFFIX = r"\s*[-|–—]\s*(dawn\.com|newspaper|reuters|bbc|cnn|nhk|asahi|yomiuri|nikkei|kyodo|연합뉴스|동아일보|조선일보|중앙일보|cctv|global times).*$"
MENU_START = r"^(?:關鍵字\s*[:：]|关键词\s*[:：]|Keywords?\s*[:：]|跳到主要內容|網站導覽|展開搜尋|調整頁面字體|分享至|複製連結|下載專區|下載檔案|Subscribe\b|로그인\b|구독\s*안내)"
MENU_MARKERS = ("另開新視窗", "複製連結", "下載次數", "下載檔案", "調整頁面字體", "網站導覽")
UNFINISHED_CLAUSE = r"と(?:いう|言う)(?:と|のは)$"
DEICTIC_QUESTION = r"何|どう|どっち"
DEICTIC_ANSWER = r"(?:これ|それ|あれ)です[。.]$"
SECTION_HEADING = r"^第\s*\d+\s*[節章]\s"
PREDICATE_END = r"(?:ている|される|した|する|です|ます|である)[。.]"
TRANSCRIPT_TIME = r"\[\d{1,2}:\d{2}(?::\d{2})?\]"
TAIWAN_TERMS = r"대만|台\s*[灣湾海]|臺\s*[灣海]|taiwan|formosa"
LINK_ONLY = r"^(?:(?:https?://|www\.)\S+|(?:com|org|net|cn|tw|hk|jp|kr|edu|gov|io)/\S+)$"
ADDRESS_PIECE = r"^(?:[A-Za-z0-9-]+\.)+$"
FOOTER_ADDRESS = r"^[^.!?。]{1,100}\|\s*www\.$"
BROKEN_ADDRESS = r"^(?:com|org|net|cn|tw|hk|jp|kr|edu|gov|io)\\"
LINK_LIST = r"^(?:References?|Sources?|참고\s*자료|출처|参考资料|參考資料)\s*[:：]"
ACCESS_NOTICE = r"this is a premium article available exclusively (?:to|for) subscribers|already a subscriber\?\s*log in(?: here)?|(?:register|log in|sign in)(?: now)? to continue reading(?: this article)?"
ATTRIBUTIONS = (
    r"(?:according to|reported by|citing|cited by)\s+([A-Z][a-zA-Z\s]{2,25})",
    r"(?:인용한|보도한 바에 따르면|에 따르면|발표에 따르면)\s*([가-힣A-Za-z]{2,15})",
    r"(?:据|援引|转引自)\s*([A-Za-z一-鿿]{2,15})\s*(?:报道|消息|称)",
    r"(?:によると|によれば|が報じたところによれば)\s*([A-Za-z一-鿿぀-ヿ]{2,15})",
)
QUOTE_CHARS = 1600
QUOTE_MARKS = r"[。！？۔؟।॥][」』”\"]*|[.!?][”’\"\)\]]*(?=\s|$)"
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "inc", "corp", "ltd", "co", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "vs", "etc", "no")
PAYWALL = ("subscribe to read", "active subscription", "로그인 후", "구독회원 전용", "有料会員")
CLAIM_BOILERPLATE = r"^(?:Subscribed with|Logout and Login|Account subscription|Unlock these|Products you|Additional Subscription|Account Settings|Need help with your subscription|Voluntary Subscription|Hana Bank|Delivering Valuable News|This video was produced using AI|Your ['’]|Subscribe\b|구독\s*안내|로그인\b|\d[\d.,]*[KMB]?\s+(?:subscribers|likes|views)|Posted\s*:|Channel\s*:)"

# Entities and topics.
ENTITY_VARIANTS = {
    "인도": ("India", "Indian", "भारत", "हिंदुस्तान", "بھارت", "انڈیا", "ہندوستان"),
    "파키스탄": ("Pakistan", "Pakistani", "पाकिस्तान", "پاکستان"),
    "대만해협": ("대만 해협", "台湾海峡", "台灣海峽", "臺灣海峽", "台海", "臺海", "Taiwan Strait", "Formosa Strait"),
    "중국": ("China", "Chinese", "中国", "中國", "北京", "中共", "解放军", "解放軍"),
    "대만": ("Taiwan", "Taiwanese", "台湾", "台灣", "臺灣"),
}
NAME_ENDINGS = {"india": "n", "pakistan": "i"}
QUALIFIERS = (" authorities", " government", " 당국", " 정부", "当局", "當局", "政府", " अधिकारियों", " सरकार", " حکام", " حکومت")
SECURITY_TERMS = (
    "military", "army", "armed forces", "troops", "warship", "navy", "naval", "missile",
    "airstrike", "air strike", "border", "terror", "ceasefire", "nuclear",
    "군사", "군대", "군함", "해군", "공습", "미사일", "국경", "테러", "휴전", "핵무기",
    "軍事", "军事", "軍隊", "军队", "軍艦", "军舰", "海軍", "海军", "空襲", "空袭",
    "導彈", "导弹", "邊境", "边境", "恐怖", "停火", "核武", "軍用機", "军用机",
    "部隊", "空爆", "ミサイル", "国境", "テロ", "停戦", "核兵器",
    "war", "invasion", "blockade", "conflict", "deterrence", "peace and stability",
    "國防", "国防", "軍演", "军演", "演習", "演习", "武力", "戰爭", "战争",
    "侵台", "侵略", "威脅", "威胁", "衝突", "冲突", "封鎖", "封锁",
    "和平穩定", "和平稳定", "평화·안정", "침공", "봉쇄", "抑止",
    "सैन्य", "सेना", "सीमा", "आतंक", "गोलीबारी", "युद्धपोत", "नौसेना", "मिसाइल",
    "فوج", "سرحد", "دہشت", "فائرنگ", "جنگی جہاز", "بحری", "میزائل",
    "کشیدگی", "تنازع", "جارحیت", "حملہ", "حملے", "جنگی", "ایٹمی جنگ", "جھڑپ", "مسلح",
)
BRIEFING_QUESTION = r"(?:^|\n)\s*[*_]*(?:(?:[^\n:：]{0,24})?(?:记者|記者)|问|問|Question|Q)\s*[*_]*[:：]"
OFFICIAL_DOMAINS = {"CN": ("mod.gov.cn", "ccg.gov.cn", "gwytb.gov.cn"), "TW": ("mnd.gov.tw", "president.gov.tw")}
PARTY_NAMES = {"CN": "중국", "TW": "대만"}
TERM_RULES = (
    (("九二共识", "九二共識", "92年コンセンサス"), r"9\s*[·.]\s*2\s*합의|9월\s*2일\s*합의", "92 컨센서스(1992년 합의)"),
    (("赖清德", "賴清德", "頼清徳", "Lai Ching-te"), r"뤄칭덕|라칭덕|라이칭덕|뤄징더", "라이칭더"),
    (("共機", "共机"), r"공습기", "중국 군용기"),
    (("不可分の一部", "不分の一部"), r"분할될\s*수\s*있는\s*일부", "불가분의 일부"),
    (("张晗", "張晗"), r"장한잉", "장한"),
    (("国务院台办", "國務院臺辦", "国務院台湾事務弁公室"), r"국무원\s*대만총국", "중국 국무원 대만사무판공실"),
)
TOPIC_ROUTES = (("india-pakistan", "인도|파키스탄|카슈미르|india|pakistan|kashmir"), ("taiwan-strait", "대만|타이완|taiwan"))
SCRIPT_LABELS = {"ja": "일본어", "en": "영문", "ko": "한국어", "hi": "힌디어", "ur": "우르두어"}
CHINESE_LABELS = {"TW": "번체", "HK": "번체"}
CHINESE_LABEL = "간체"
QUESTION_FLAGS = {
    "comparison": "비교",
    "both_sides": "양측|양쪽|두당사자",
    "major_reports": "주요보도|주요뉴스",
    "positions": "입장",
    "matching": "(?<!불)일치",
    "conflicting": "상충|불일치|모순",
    "unverified": "미확인|확인되지않|검증되지않",
    "sources": "출처|근거자료",
}

# Dates and times.
UTC_HOURS = {"UTC": 0, "KST": 9, "JST": 9, "Asia/Shanghai": 8}
ZONE_WORDS = {"UTC": r"UTC|协调世界时|協調世界時|協定世界時", "KST": r"KST|한국\s*시간|한국\s*표준시", "JST": r"JST|日本時間|日本標準時", "Asia/Shanghai": r"北京时间|北京時間"}
URL_DATES = (r"/(20\d{2})[-/](\d{2})[-/](\d{2})", r"(?:AKR|/|_)(20\d{2})(\d{2})(\d{2})\d{4,}", r"-(20\d{2})-(\d{2})-(\d{2})\b")
HEAD_DATE = r"(?:송고|수정|입력|발행)?\s*(20\d{2})[-년\.]\s*(\d{1,2})[-월\.]\s*(\d{1,2})"
HEAD_MONTH_DATE = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+(\d{1,2}),?\s+(20\d{2})"
HEAD_HAN_DATE = r"(20\d{2})年\s*(\d{1,2})月\s*(\d{1,2})日"
ROC_HEADER = r"(?:區域動態|新聞稿|新聞澄清|本部新聞)\s*(\d{2,3})[.](\d{1,2})[.](\d{1,2})\s*發布單位"
ROC_LINE = r"(?m)^\s*(?:發布日期[：:]?\s*)?(\d{2,3})年\s*(\d{1,2})月\s*(\d{1,2})日\s*$"
OFFICIAL_HEADER = r"(?:发布时间|發佈時間|發布時間|來源|来源)[^\n]{0,100}?(20\d{2})[-/](\d{1,2})[-/](\d{1,2})"

# Lines of a page that are no article text.
SNIPPET_NOISE = (
    r"(?i)^(title|headline|제목)\s*:\s*",
    r"(?i)^(송고|수정|등록|발행|입력|updated|published)\s*[:\d\-\s\./년월일시분초]+$",
    r"(?i)^(송고|수정)\s*\d{4}[-년\.]\s*\d{1,2}[-월\.]\s*\d{1,2}[-일\.]?\s*\d{1,2}시?\d{1,2}분?(\d{1,2}초)?$",
    r"^\s*(\*|\-)?\s*([가-힣A-Za-z\s]{2,15})(기자|특파원|기고자|선임기자)\s*$",
    r"(?i)^\s*(by|written by|author:?)\s+[A-Za-z\s]{2,30}$",
    r"^\s*撰文[：:]\s*[一-鿿\s]{2,10}\s*$",
    r"^\s*(出版|更新)[：:]\s*.*$",
    r"(?i)^\s*(\[자료사진\]|\[사진\s*출처.*?\]|▲\s*.*?|▼\s*.*?|photo\s*:.*?|사진\s*=.*?)\s*$",
    r"^\s*이미지\s*확대\s*.*$",
    r"(제보는\s*카카오톡|okjebo|\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b)",
    r"(?i)^\s*(세\s*줄\s*요약|search|cancel|email|listen to article|join our whatsapp)\s*$",
)
PORTAL_NOTICES = ("인공지능이 자동으로 줄인", "세 줄 요약 기술을 사용합니다", "기사 본문과 함께 읽어야 합니다", "연합뉴스 기사를 우선적으로 보여줍니다", "재판매 및 DB 금지", "기자 프로필", "구독하기", "포토 슬라이드", "listen to article", "join our whatsapp channel", "all rights reserved")
BRACKETED = r"^\s*(\[.*?\]|\(.*?\))\s*$"
CAPTION_AGENCIES = ("사진", "연합뉴스", "로이터", "EPA", "AFP", "자료사진", "Graphic", "그래픽")
NOTICE_SENTENCES = ("세 줄 요약", "기사 본문과 함께 읽어야", "구글 검색에서")
FOOTERS = (
    r"^\s*(?:#{1,6}\s*)?\*{0,2}(?:에디터스\s*(?:픽|바)|editor['’]?s['’]?\s*(?:picks?|bar))\b",
    r"^#+\s*(\[)?(read more|most popular|latest stories|related (stories|articles|news)|popular stories|opinion|editorial|top stories|trending|recommended)",
    r"^#+\s*(\[)?(관련\s*기사|추천\s*기사|인기\s*기사|관련\s*뉴스|인기\s*뉴스|핫뉴스|에디터스\s*픽|editor'?s\s*picks?|많이\s*본\s*뉴스|주요\s*뉴스|랭킹뉴스|헤드라인|주요이슈)",
    r"^\s*(에디터스\s*픽|editor'?s\s*picks?|많이\s*본\s*뉴스|주요\s*뉴스|유튜브\s*채널|랭킹뉴스|핫뉴스|추천뉴스|실시간\s*인기)\b",
    r"^\s*\*{0,2}(공유하기|본문\s*글자\s*크기\s*조정|댓글|뉴스\+?|트렌드뉴스|외국어\s*뉴스|뉴스상품|출판물|서비스안내|SNS)\*{0,2}\s*$",
    r"^\s*comments closed\s*$",
    r"^\s*0\s*$",
    r"저작권자\(c\)",
    r"무단\s*전재[-–—\s]*재배포",
    r"(\*\[제보는|\b제보는\s*카카오톡|\bokjebo\b)",
)
BANNER_WORDS = (
    "본문 바로가기", "메뉴 바로가기", "기사제보", "all rights reserved", "copyright", "epaper", "live tv", "gift a subscription", "you are logged in",
    "english", "繁體版", "网站地图", "跳到中央內容區塊", "點這裡瞭解", "privacy statement", "本網站使用相關技術", "share this article", "follow us on", "subscribe to",
    "active subscription", "구독하기", "get the latest news", "whatsapp channel", "story comments", "공유하기", "url이 복사되었습니다", "본문 글자 크기 조정",
    "다양한 채널에서 연합뉴스를 만나보세요", "세 줄 요약 기술을 사용합니다", "not now allow notifications", "allow notifications", "subscribe to notifications",
    "get the latest news and updates from dawn", "recipient email", "your name*", "listen to article", "join our whatsapp channel", "dawnnews urdu",
    "subscribed with another email", "logout and login", "account subscription benefits", "premium stories", "editorials, opinions", "additional subscription benefits",
    "account settings", "need help with your subscription", "voluntary subscription fee", "your 'subscription' and 'like'", "products you've access to", "see all newsletters",
    "newsletter-international", "newslettersignup", "first day first show", "the view from india", "looking at world affairs",
)
STRONG_BANNER_WORDS = ("subscribe", "newsletter", "logout", "logged in", "products you've access to")
PAGE_LINES = (
    ("검색창 UI", r"^\s*search\s*$"),
    ("취소 버튼 UI", r"^\s*cancel\s*$"),
    ("이메일 공유 폼", r"^\s*#+\s*email\s*$"),
    ("오디오 플레이어 UI", r"^\s*\[audio\s*\d+\].*?$"),
    ("단독 발행일자 라인", r"^\s*published\s+[a-zA-Z]+\s+\d+,\s+\d{4}\s*$"),
    ("언론사 바이라인 푸터", r"^\s*_\s*published in dawn.*?\s*_\s*$"),
    ("전자신문 헤더", r"^\s*e-paper\s*\|\s*[a-zA-Z]+\s+\d+,\s+\d{4}\s*$"),
    ("헤더 기사링크", r"^#+\s*\[.*?\]\(.*?\)\s*$"),
    ("바이라인 링크", r"^\[.*?\]\(.*?\)\s*(published)?$"),
    ("단독 링크 라인", r"^\s*(\*|\-)?\s*\*{0,2}\[.*?\]\(https?://.*?\)\*{0,2}\s*$"),
    ("경로 탐색(브레드크럼)", r"^(\s*(\[.*?\]\(.*?\)|[>/»›\|·\-])\s*)+(/정문|/正文|/)?$"),
)
CUT_LABELS = {
    "transcript": "유튜브 메타데이터(설명란 등) 배제 및 자막 우선 추출",
    "layout": "내비게이션/헤더/푸터 태그",
    "picture": "광고/이미지 태그",
    "access": "구독 전용/로그인/가입 안내 문장",
    "image": "마크다운 이미지 블록",
    "menu": "메뉴/링크 목록",
    "footer": "하단 추천기사/사이드바/댓글 블록 절단",
    "links": "연속 추천링크 블록 감지 절단",
    "banner": "구독/광고/안내 배너",
}
ARTICLE_ATTRIBUTES = ("content", "article", "main", "body", "news", "post")
