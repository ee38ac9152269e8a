"""Fixed values of Hebrew sports headlines, and the reading of words they need.

All of it is data that a rule table takes; operators get it through ``NameRules`` and a vocabulary table, so that texts in
another script use other words with the same operators.
"""

from __future__ import annotations

# Fixed values. Letters that stand before a word without a space.
PREFIXES = "בהלמכשו"
# Fixed values. Words that carry no content, and furniture of headlines.
STOP_WORDS = """
של על עם את אחרי לפני הוא היא זה מה כל גם רק אבל כי אם או לא כבר עוד יותר מאוד
בין תוך אל אך אז יש אין היה הייתה יהיה להיות עד מול נגד לאחר בעקבות במסגרת בגלל
למרות כדי איך מתי איפה מי למה כמה אשר כאשר שלא שלו שלה הזה הזאת אלה אותו אותה
""".split()
TEMPLATE_WORDS = """
רשמי רשמית דיווח דרמה דיווחים חושף נחשף בלעדי פרסום ראשון טור תקציר צפו בתמונות
ממשיכה להתחזק ממשיך להתחזק מתחזקת סיכום עדכון מיוחד בלעדית
""".split()
# Fixed values. Words that many stories share: they may add to similarity but are never evidence of one story.
GENERIC_WORDS = """
מכבי הפועל בית"ר בית״ר ביתר עירוני בני maccabi hapoel beitar ironi
תל אביב אבייב
עונה העונה עונת פתחה פתח פותחת נפתחה
ניצחון ניצחונות ניצחה ניצח מנצחת מנצח הפסד הפסידה הפסיד תיקו
משחק המשחק משחקים משחקי מפגש דרבי
ליגה הליגה ליגת אליפות גביע הגביע
קבוצה הקבוצה קבוצות קבוצת מועדון המועדון
שחקן השחקן שחקנים שחקני כוכב הכוכב
מאמן המאמן מאמנים אימון אימונים
חוזה החוזה חוזים חתם חתמה חתמו חותם חותמת החתמה מחתימה מחתימות חתימה
האריך מאריך הארכה מוארך
גארד הגארד סנטר הסנטר פורוורד רכז שוער חלוץ בלם קשר
אמריקאי האמריקאי אמריקאים זר הזר זרים
רכש הרכש צירוף מצרף חיזוק חיזוקים
עסקה העסקה עסקת מגעים משא ומתן
דקה דקות שער שערים נקודות נקודה
סיום הסתיים מסיימת מסיים
יריבה יריב מארחת אורחת ביתי חוץ
נבחרת הנבחרת כדורסל כדורגל טניס
עונתי מקום טבלה
""".split()
# Fixed values. What happens, what it costs and how many: never part of a name.
ACTION_WORDS = """
חתם חתמה חתמו סיכם סיכמה סיכמו האריך האריכה הצטרף הצטרפה עוזב עוזבת עזב עזבה
נפרד נפרדה נפרדו מתרחק מתרחקת ישחק תשחק שיחק ששיחק שיחקה יגיע תגיע הגיע הגיעה
פוצץ פוצצו הציגה הציג הכריז הודיע דיווח נחשף פורסם צפוי צפויה יחתום תחתום
מנהל מנהלים סגר סגרה סגרו קיבל קיבלה ניצח ניצחה הפסיד הפסידה פותח פותחת לפתוח
מאיים מאיימים בוחן שיבחן לקח מתחזקת ירדו נעדר נבחר זכה זכתה
""".split()
MONEY_WORDS = """
חוזה חוזהו שכר שכרו שנים שנתיים לשנתיים לשלוש לשנה נוספות נוספת עונה עונות
מיליון מיליוני אלף דולר יורו שקל שקלים סעיף יציאה תנאיו הארכת מו מגעים
בשיחות שיחות במו הצעה מועמד מועמדים
""".split()
NUMBER_WORDS = """
אחד אחת שני שתי שניים שלוש שלושה ארבע ארבעה חמש חמישה שש שישה שבע שבעה
שמונה תשע עשר עשרה ראשון ראשונה שנייה שלישי
""".split()
# Fixed values. Words beside a name that say what part it plays.
ROLE_TITLES = "מאמן מאמנת המאמן הרכש הבעלים בעלים נשיא המנהל מנהל סוכן הסוכן קפטן שופט השופט".split()
POSSESSIVES = ("של",)
OPPONENT_MARKERS = ("מול", "נגד", "יריבה", "יריבת")
# Fixed values. What a report of a match that is still being played says.
LIVE_PARTS = ("מחצית", "שידור חי", "לייב", "live")
LIVE_WORD = "חי"
# Fixed values. Characters that part words, and a run of letters and their marks.
PUNCTUATION = r"""["״׳'`“”‘’.,:;!?|()\[\]{}/\\\-–—]"""
LETTERS = r"""[֐-׿׳״'"-]+"""
