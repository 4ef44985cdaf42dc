"""Word lists and patterns that results depend on."""

from __future__ import annotations

# Fixed values. Separators between the sides of a pair, in order of priority.
SEPARATORS = [" - ", " – ", " — ", " | ", " / ", " : ", ": ", " ~ ", " _ "]

# Fixed values. Words that mark a section, not a song.
SECTION_WORDS = [
    "축가", "행진", "입장", "퇴장", "bgm", "브금", "playlist", "setlist",
    "tracklist", "music", "song list", "추천곡", "문의", "contact", "timeline", "time line",
    "플레이리스트", "출처", "weibo", "사진 출처", "이미지 출처",
    "pinterest", "comment", "comments",
    "instagram", "twitter", "facebook", "tiktok", "tumblr",
    "photo", "image", "cover", "artwork", "thumbnail",
    "광고", "스킵", "협찬", "스폰서", "광고구간", "광고시작", "광고끝", "인스타그램",
    "썸네일", "섬네일", "노래 모음", "노래모음", "케이팝", "걸그룹", "여돌", "노동요", "매장에서 틀기 좋은",
]

# Fixed values. Words of a playlist's own title.
PLAYLIST_WORDS = ["playlist", "kpop", "노래 모음", "노래모음", "플레이리스트", "케이팝", "걸그룹", "여돌", "노동요"]

# Fixed values. Hints of a sentence.
SENTENCE_WORDS = ["오늘", "이번", "추천", "감사", "사랑", "응원", "즐감", "좋아요", "구독", "please", "hope", "thanks", "enjoy", "subscribe", "comment", "watch"]

# Fixed values. Lines that aren't music; \w is written out, so that engines agree.
NOT_MUSIC = [
    r"https?://\S+", r"www\.\S+", r"\S+@\S+\.\S+", r"^\s*문의[:]?", r"^\s*contact[:]?", r"^\s*instagram[:]?", r"^\s*email[:]?", r"^\s*phone[:]?",
    r"^\s*thank you\b.*", r"^\s*listen on\b.*", r"^\s*available on\b.*", r"^\s*\*?timeline\b.*", r"^\s*time line\b.*", r"^\s*음원으로 인한 수익.*",
    r"^\s*수익은 발생하지 않습니다.*", r"^\s*all rights reserved.*", r"^\s*provided by\b.*", r"^\s*provided to youtube by.*", r"^\s*ost\s*[:|].*",
    r"(?:문장|시집|수록된|수록되어).*(?:입니다|있구요|있고요)", r"는\s*'.+\s[-–—]\s.+'$",
    r"^\s*(?:ig|insta|instagram|spotify|yt|youtube|tiktok|soundcloud)\s*[:|]\s*@?[\p{L}\p{N}_.\-]{2,}\s*$",
    r"사진\s*출처", r"이미지\s*출처", r"photo\s*(?:credit|source|by)\b", r"image\s*(?:credit|source|by)\b",
    r"@[\p{L}\p{N}_]+\s*$", r"[\x{1D400}-\x{1D7FF}]",
    r"^\s*[▶►▷]\s*구독", r"^\s*[▶►▷]\s*좋아요", r"^\s*[▶►▷]\s*알림", r"^\s*✔\s*저작권", r"^\s*📌", r"^\s*⬇",
    r"^\s*이\s*영상의\s*모든\s*(?:음악|노래|곡)", r"^\s*본\s*영상에\s*사용(?:된|되는|한)", r"^\s*저작권은\s*(?:해당|원)", r"^\s*(?:구독|좋아요|알림설정)\s*(?:눌러|부탁|해주)",
    r"^\s*(?:앨범|album)\s*[:：]\s*$", r"^\s*(?:track\s*list|트랙\s*리스트|tracklist)\s*$", r"^\s*(?:재생목록|플레이리스트)\s*[:：]?\s*$",
    r"^\s*(?:업로드|upload|posted)\s*(?:by|:)", r"^\s*제\s*\d+\s*(?:편|화|회)\s*$",
    r"^\s*sponsored?\s+by\b", r"^\s*this\s+(?:video|content)\s+(?:is|was)\s+(?:sponsored|brought\s+to\s+you)\b", r"^\s*in\s+(?:paid\s+)?partnership\s+with\b",
    r"^\s*thanks?\s+to\s+(?:our\s+)?sponsor", r"^\s*(?:ad|ads)\s*(?:break|start|end|here)?\s*$", r"^\s*skip\s+(?:intro|this|ad|ads|chapter|sponsor|me)\b",
    r"^\s*광고\s*(?:시작|끝|구간|스킵|건너뛰기|skip)", r"^\s*광고를?\s*건너뛰", r"^\s*(?:ppl|광고주|협찬사)\s*[:：]", r"^\s*협찬\s*[:：]",
]

# Fixed values. Word hints of the direction scores.
TITLE_HINTS_KO = ["사랑", "이별", "기억", "시간", "마음", "오늘", "내일", "우리", "너", "나", "존재", "춤", "좋아요", "불편해"]
ARTIST_CONNECTORS = ["feat", "ft", "&", ",", " x "]
TITLE_FIRST_WORDS = ["the", "a", "an", "my", "your", "our", "this", "that"]
TITLE_VERBS = ["is", "are", "was", "were", "be", "build", "love", "hate", "need", "want"]
TITLE_LAST_WORDS = ["mine", "more", "sick", "dance", "umbrella", "vida"]
KNOWN_GROUPS = ["shinee", "bigbang", "2ne1", "girls generation", "girls' generation", "snsd", "wonder girls", "소녀시대", "인피니트", "비스트", "beast", "highlight"]
NOISE_WORDS = ["official", "audio", "video", "lyrics", "lyric", "mv", "ost", "remix", "version", "ver", "remaster", "remastered", "prod", "produced"]
SUSPICIOUS_WORDS = ["karaoke", "cover", "tribute", "inst", "instrumental", "mr", "live", "concert", "remix", "sped up", "slowed", "8d", "nightcore"]

# Fixed values. Words of a version that isn't taken for the song unless the song names one too; words of noise in a frame.
BLOCKING_WORDS = ["cover", "cover ver", "remix", "live", "instrumental", "inst", "karaoke", "acoustic", "piano", "piano version"]
FRAME_NOISE = ["subscribe", "youtube", "instagram", "comment", "playlist", "tracklist", "official", "cover", "lyrics"]

# Fixed values. Headers of a list of music cards.
MUSIC_HEADERS = ["곡", "song", "songs", "music", "음악", "노래", "트랙", "track", "tracks"]

# Fixed values. Pronouns after "with" that belong to a title.
WITH_PRONOUNS = ["me", "you", "us", "him", "her", "them", "it", "myself", "yourself"]

# Fixed values. Artist names and their aliases, a part of the known dictionary; a catalogue's own aliases are passed as a table.
ARTIST_ALIASES = {
    "클래지콰이": ["clazziquai", "clazziquai project"], "롤러코스터": ["roller coaster", "rollercoaster"], "윤상": ["yoon sang"], "악뮤": ["akmu", "akdong musician"],
    "소녀시대": ["Girls' Generation", "Girls Generation", "SNSD"], "아이유": ["IU"], "백예린": ["Yerin Baek"], "태연": ["TAEYEON"], "방탄소년단": ["BTS"], "블락비": ["Block B"],
    "엔하이픈": ["ENHYPEN"], "백현": ["BAEKHYUN"], "아이콘": ["iKON"], "지드래곤": ["G-DRAGON"], "엑소": ["EXO"], "지코": ["ZICO"], "딘": ["DEAN"], "크러쉬": ["Crush"], "헤이즈": ["Heize"],
    "엔시티": ["NCT"], "엔시티 127": ["NCT 127"], "엔시티 드림": ["NCT DREAM"], "원슈타인": ["Wonstein"], "더보이즈": ["THE BOYZ"], "라이즈": ["RIIZE"], "트레저": ["TREASURE"],
    "세븐틴": ["SEVENTEEN"], "레드벨벳": ["Red Velvet", "REDVELVET"], "트와이스": ["TWICE"], "원더걸스": ["Wonder Girls"], "샤이니": ["SHINee"], "실키보이즈": ["SILKYBOIS"], "개코": ["Gaeko"],
}
TITLE_ALIASES = {"밤편지": ["Through the Night"], "좋은 날": ["Good Day"], "팔레트": ["Palette"], "에잇": ["eight"], "어디에도": ["Nowhere"], "홀씨": ["Dandelion"], "동화": ["Fairy Tale"]}

# Fixed values. Words that don't count in token overlap.
STOPWORDS = ["official", "audio", "mv", "m v", "music", "video", "lyrics", "lyric", "live", "ver", "version", "remaster", "remastered", "inst", "instrumental", "cover", "karaoke", "sped", "up", "slowed", "acoustic"]

# Fixed values. Words that mark generated content.
AI_WORDS = ["ai 음악", "ai음악", "인공지능 음악", "인공지능음악", "ai로 만든", "ai가 만든", "ai 커버", "ai커버", "ai 생성", "ai생성", "ai 제작", "ai제작", "ai 노래", "ai노래", "ai generated", "ai-generated", "ai music", "ai cover", "ai song", "suno", "udio", "artificial intelligence music"]

# Fixed values. Words of other versions, and words that a catalogue adds to names.
VERSION_WORDS = ["live", "concert", "remix", "remastered", "remaster", "instrumental", "inst", "acoustic", "sped up", "slowed", "karaoke", "nightcore", "8d", "version", "ver", "cover", "radio edit", "edit"]

# Fixed values. Messages for people by reason.
MODE_ALIASES = {"": "text", "text": "text", "ocr": "ocr", "video": "ocr", "vision": "ocr", "acr": "acr", "audio": "acr"}
