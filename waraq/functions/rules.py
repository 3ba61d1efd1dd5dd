"""Fixed values of the Arabic text functions: patterns, letter tables and word lists."""

# They must be exactly these for right results.

#: A run of Arabic characters (punctuation, digits and marks of both blocks included).
ARABIC_RUN = "[؀-ۿݐ-ݿ]+"
#: Vowel marks, dropped by the normal form.
TASHKEEL = "".join(chr(c) for c in (*range(0x064B, 0x0660), 0x0670))
#: Letters that the normal form unifies, and what with.
UNIFIED_FROM, UNIFIED_TO = "إأآىةؤئ", "ااايهوي"

#: Query letter -> vocabulary letters that stand in for it at half cost. Not symmetric.
SIMILAR_LETTERS = {
    "ب": "تثنيى", "ت": "بثنيى", "ث": "بتنيى", "ن": "بتثيى",
    "ج": "حخ", "ح": "جخ", "خ": "جح",
    "د": "ذ", "ذ": "د", "ر": "ز", "ز": "ر", "س": "ش", "ش": "س",
    "ص": "ض", "ض": "ص", "ط": "ظ", "ظ": "ط", "ع": "غ", "غ": "ع",
    "ف": "ق", "ق": "ف", "ك": "ل", "ل": "ك", "ه": "ة", "ة": "ه",
    "و": "ؤ", "ؤ": "و", "ي": "ئى", "ى": "يئ", "ئ": "يى",
    "ا": "أإآ", "أ": "اإآ", "إ": "اأآ", "آ": "اأإ", "م": "ن",
}

#: Start-of-word letter swaps of the correction cascade, in order.
LIGATURES = (
    ("اجل", "الج"), ("احل", "الح"), ("اخل", "الخ"), ("ادل", "الد"), ("اذل", "الذ"), ("ارل", "الر"), ("ازل", "الز"),
    ("اسل", "الس"), ("اشل", "الش"), ("اصل", "الص"), ("اضل", "الض"), ("اطل", "الط"), ("اظل", "الظ"), ("اعل", "الع"),
    ("اغل", "الغ"), ("افل", "الف"), ("اقل", "الق"), ("اكل", "الك"), ("انل", "الن"), ("اول", "الو"), ("ايل", "الي"),
    ("دالخ", "داخل"),
)
#: Words that rightly begin with these two letters and are left alone.
ALLOWED_VERBS = (
    "ألزم", "ألزمت", "ألزمه", "ألزمها", "ألزمهم", "ألغى", "ألغت", "ألغيت", "ألغوا", "ألحق", "ألحقت", "ألحقه",
    "ألقى", "ألقت", "ألف", "ألفا", "ألوف", "ألفاظ", "ألفة", "ألوان", "ألواح", "ألعاب", "ألغاز", "ألحان", "ألياف",
    "ألم", "ألما", "ألبان", "ألبسة", "ألق", "ألقاب",
)
#: Literal swaps of steps 10 and 12, in order.
CONJUNCTION_LOW = (("واإل", "والإ"), ("باإل", "بالإ"), ("لإل", "للإ"), ("فاإل", "فالإ"), ("كاإل", "كالإ"))
CONJUNCTION_HIGH = (("واأل", "والأ"), ("باأل", "بالأ"), ("لأل", "للأ"), ("فاأل", "فالأ"))

#: Badges by a word in the lower-cased file name, the first hit wins, and the label of the rest.
BADGES = (("ظهير", "ظهير شريف"), ("مرسوم", "مرسوم بقانون"), ("قرار", "قرار وزاري"))
OTHER_BADGE = "وثيقة"
#: Heading of a page in text exports.
PAGE_HEADING = "=== صفحة %d ===\n"
#: Around a word that matches the query.
MARK_OPEN = '<mark style="background:#fde68a;padding:1px 5px;border-radius:3px;font-weight:700;color:#0b192c;">'
MARK_CLOSE = "</mark>"
#: Vision models in order of preference, and what is taken where none is there.
VISION_MODELS, DEFAULT_MODEL = ("qwen2.5vl:3b", "qwen2.5vl:7b", "qwen3-vl:4b", "qwen2.5:1.5b"), "qwen2.5vl:3b"
VERSION = "1.0.0"
#: Languages and settings of local OCR; prompt and settings of a vision model.
LOCAL_OCR = ("ara+fra", "--psm 6 --oem 3")
VISION_PROMPT = "انسخ كل النص في هذه الصورة سطراً بسطر."
VISION_OPTIONS = {"num_ctx": 512, "num_predict": 800, "temperature": 0}

#: The correction dictionary, wrong form and right form, in order: each entry rewrites what the ones before left. Another
#: one can be passed wherever it is used (see :func:`waraq.sources.tables.read_corrections`).
CORRECTIONS = (
    ("ال سيما", "لا سيما"), ("والسيما", "ولا سيما"), ("مالحظات", "ملاحظات"), ("المالحظات", "الملاحظات"), ("مالحظة", "ملاحظة"),
    ("المالحظة", "الملاحظة"), ("بالمالحظات", "بالملاحظات"), ("مالحق", "ملاحق"), ("المالحق", "الملاحق"), ("مالبسات", "ملابسات"),
    ("المالبسات", "الملابسات"), ("مالءمة", "ملاءمة"), ("مالئمة", "ملائمة"), ("المالءمة", "الملاءمة"), ("مالحقة", "ملاحقة"),
    ("المالحقة", "الملاحقة"), ("إعالنات", "إعلانات"), ("الإعالنات", "الإعلانات"), ("إعالن", "إعلان"), ("الإعالن", "الإعلان"),
    ("اعالم", "اعلام"), ("الاعالم", "الاعلام"), ("إعالم", "إعلام"), ("الإعالم", "الإعلام"), ("معالومات", "معلومات"),
    ("المعالومات", "المعلومات"), ("الإرسلا", "الإرسال"), ("إرسلا", "إرسال"), ("الإيصلا", "الإيصال"), ("إيصلا", "إيصال"),
    ("الاستقبلا", "الاستقبال"), ("استقبلا", "استقبال"), ("الانتقلا", "الانتقال"), ("انتقلا", "انتقال"), ("الاتصلا", "الاتصال"),
    ("اتصلا", "اتصال"), ("الاستقلا", "الاستقلال"), ("استقلا", "استقلال"), ("الانفصلا", "الانفصال"), ("انفصلا", "انفصال"),
    ("الإدخلا", "الإدخال"), ("إدخلا", "إدخال"), ("الإكملا", "الإكمال"), ("إكملا", "إكمال"), ("ﺍﷲ", "الله"),
    ("اال", "الا"), ("االشتراك", "الاشتراك"), ("االتزام", "الالتزام"), ("االعتراض", "الاعتراض"), ("االستئناف", "الاستئناف"),
    ("االتصال", "الاتصال"), ("االقتصادي", "الاقتصادي"), ("ألحكام", "الأحكام"), ("ألشخاص", "الأشخاص"), ("ألطراف", "الأطراف"),
    ("ألعمال", "الأعمال"), ("ألمر", "الأمر"), ("ألموال", "الأموال"), ("ألنظمة", "الأنظمة"), ("ألساس", "الأساس"),
    ("ألفراد", "الأفراد"), ("ألوضاع", "الأوضاع"), ("ألصول", "الأصول"), ("ألجهزة", "الأجهزة"), ("ألقسام", "الأقسام"),
    ("ألسباب", "الأسباب"), ("ألهداف", "الأهداف"), ("ألول", "الأول"), ("ألولى", "الأولى"), ("ألخير", "الأخير"),
    ("ألخيرة", "الأخيرة"), ("ألدلة", "الأدلة"), ("ألرقام", "الأرقام"), ("ألحداث", "الأحداث"), ("ألعضاء", "الأعضاء"),
    ("ألمانة", "الأمانة"), ("ألمين", "الأمين"), ("ألجانب", "الأجانب"), ("ألحوال", "الأحوال"), ("ألوقاف", "الأوقاف"),
    ("ألصناف", "الأصناف"), ("ألدوار", "الأدوار"), ("ألمانات", "الأمانات"), ("العالدة", "العادلة"), ("العالد", "العادل"),
    ("بالعالدة", "بالعادلة"), ("للعالدة", "للعادلة"), ("عالدة", "عادلة"), ("عالد", "عادل"), ("باستقالل", "باستقلال"),
    ("استقالل", "استقلال"), ("الاستقالل", "الاستقلال"), ("استقاللية", "استقلالية"), ("الاستقاللية", "الاستقلالية"), ("حاالت", "حالات"),
    ("الحاالت", "الحالات"), ("الصيما", "لا سيما"), ("اليزال", "لا يزال"), ("اليجوز", "لا يجوز"), ("اليمكن", "لا يمكن"),
    ("القاعضي", "القاضي"), ("قاعضي", "قاضي"), ("للقاعضي", "للقاضي"), ("بالقاعضي", "بالقاضي"), ("التقاعضي", "التقاضي"),
    ("تقاعضي", "تقاضي"), ("مقتغضى", "مقتضى"), ("بمقتغضى", "بمقتضى"), ("مقتغضيات", "مقتضيات"), ("يقغضي", "يقضي"),
    ("القغضاء", "القضاء"), ("قغضائي", "قضائي"), ("القغضائي", "القضائي"), ("القغضايا", "القضايا"), ("الآشيء", "الشيء"),
    ("الآشياء", "الأشياء"), ("شخظصي", "شخصي"), ("شخظصية", "شخصية"), ("الشخظصي", "الشخصي"), ("شخظص", "شخص"),
    ("أشخظاص", "أشخاص"), ("الأشخظاص", "الأشخاص"), ("اراعضي", "أراضي"), ("أراعضي", "أراضي"), ("الوطصي", "الوصي"),
    ("الوطصاية", "الوصاية"), ("الرئيؠسي", "الرئيسي"), ("الرئيؠس", "الرئيس"), ("املدة", "المادة"), ("الماذة", "المادة"),
    ("المادو", "المادة"), ("الماد ة", "المادة"), ("الادة", "المادة"), ("احملكمة", "المحكمة"), ("امحلكمة", "المحكمة"),
    ("احمكمة", "المحكمة"), ("امحكمة", "المحكمة"), ("احملاكم", "المحاكم"), ("ادلعي", "المدعي"), ("ادلعوى", "الدعوى"),
    ("ادلفاع", "الدفاع"), ("الطاعم", "الطاعن"), ("الطاعب", "الطاعن"), ("الطعب", "الطعن"), ("الطعم", "الطعن"),
    ("احلكم", "الحكم"), ("امللف", "الملف"), ("اجللسة", "الجلسة"), ("احلضور", "الحضور"), ("الغباب", "الغياب"),
    ("الفقره", "الفقرة"), ("الفصح", "الفصل"), ("القضاع", "القضاء"), ("التبلبغ", "التبليغ"), ("النيابه", "النيابة"),
    ("الهيئه", "الهيئة"), ("الدائره", "الدائرة"), ("الإجراءأت", "الإجراءات"), ("المساطره", "المساطر"), ("الدعاوة", "الدعاوى"),
    ("الوثيقه", "الوثيقة"), ("الشهاذة", "الشهادة"), ("الشهاده", "الشهادة"), ("القراز", "القرار"), ("القرات", "القرار"),
    ("حمضر", "محضر"), ("المحضز", "المحضر"), ("السندأت", "السندات"), ("المستندأت", "المستندات"), ("الوثائكق", "الوثائق"),
    ("رمق", "رقم"), ("رقك", "رقم"), ("تاريج", "تاريخ"), ("تاريح", "تاريخ"), ("فرباير", "فبراير"),
    ("مارض", "مارس"), ("بناءأ", "بناءً"), ("وفقاأ", "وفقاً"), ("نظراأ", "نظراً"), ("طبقاأ", "طبقاً"),
    ("هاذا", "هذا"), ("هاذه", "هذه"), ("اذلي", "الذي"), ("واألطراف", "والأطراف"), ("واإلجراءات", "والإجراءات"),
    ("باألطراف", "بالأطراف"), ("باإلجراءات", "بالإجراءات"), ("لألطراف", "للأطراف"), ("لإلجراءات", "للإجراءات"), ("أماـم", "أمام"),
    ("خـالل", "خلال"), ("محكمـة", "محكمة"), ("ملرفق", "المرفق"), ("ملرافق", "المرافق"), ("صادرق", "صادر"),
    ("صادرك", "صادر"), ("ظبير شريف", "ظهير شريف"), ("ظبير", "ظهير"), ("رمضبان", "رمضان"), ("شعببان", "شعبان"),
    ("التشريبعية", "التشريعية"), ("التشريبع", "التشريع"),
)
#: Letters before which steps 17 and 18 leave a hit as it is.
KEPT_AFTER_MAL, KEPT_AFTER_AAL = "يكول", "مجياقو"
