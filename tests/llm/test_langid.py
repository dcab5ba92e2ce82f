import pytest

from nordlys.llm import langid as L

TEXTS = {
    "nb": "Han visste ikke hva hun hadde sagt til dem. Jeg kunne ikke finne noe av det de lette etter. Hvorfor ble båten liggende ved kaia? Ingen av oss fikk vite noe.",
    "nn": "Han visste ikkje kva ho hadde sagt til dei. Eg kunne ikkje finne noko av det dei leita etter. Kvifor vart båten liggjande ved kaia? Ingen av oss fekk vite noko.",
    "en": "He did not know what she had said to them. I could not find any of the things they were looking for. Why was the boat left at the quay? Nobody told us anything.",
    "de": "Er wusste nicht, was sie ihnen gesagt hatte. Ich konnte nichts von dem finden, was sie suchten. Warum blieb das Boot am Kai liegen? Niemand hat uns etwas gesagt.",
}
GREEK = "Κανείς δεν ήξερε τι έγινε στο λιμάνι. Γιατί δεν είδε κανείς τη βάρκα; Ο ταχυδρόμος ξέχασε τα δίχτυα."
ALL = TEXTS | {
    "el": GREEK,
    "ru": "Никто не знал, что случилось в порту. Почему лодка осталась у причала? Почтальон забыл сети, и рыбаки ждали его целый день. Мы говорили о погоде. Город объявил, что школьный ящик пуст, а цех закрыт. Это было ещё хуже. Утром старый рыбак нашёл письмо под камнем. Его дочь прочитала письмо вслух перед всеми соседями. Школьный учитель объяснил детям, где находится северный полюс. Поезд опоздал на три часа из-за снега. Женщина купила хлеб, молоко и свежую рыбу на рынке. Никогда раньше мы не видели такого большого корабля. Юноша построил дом из жёлтого дерева. Каждую весну река заливает поля вокруг деревни.",
    "ar": "لم يعرف أحد ماذا حدث في الميناء. لماذا بقي القارب عند الرصيف؟ نسي ساعي البريد الشباك وانتظره الصيادون طوال اليوم. تحدثنا عن الطقس كل صباح. ضاع ظرف غريب خلف الكنيسة.",
    "zh": "没有人知道港口发生了什么。船为什么留在码头？邮递员忘记了渔网，渔夫们等了他一整天。我们谈论天气。",
}
#: Languages that are not listed, each near one that is.
OTHERS = {
    "uk": "Україна є державою у Східній Європі. Її столицею є місто Київ, де живе багато людей. Вони говорять українською мовою щодня.",
    "mk": "Македонија е држава во Југоисточна Европа. Нејзиниот главен град е Скопје, каде живеат многу луѓе. Тие зборуваат македонски јазик секој ден.",
    "fa": "ایران کشوری در جنوب غربی آسیا است. پایتخت آن تهران است که مردم زیادی در آن زندگی می‌کنند. آنها هر روز به زبان فارسی گفتگو می‌کنند.",
    "ko": "한국은 동아시아에 있는 나라입니다. 수도는 서울이며 많은 사람들이 살고 있습니다. 그들은 매일 한국어로 말합니다.",
}


@pytest.fixture(scope="module")
def model():
    return L.fit_rows([(v, k) for k, v in ALL.items() for _ in range(40)] + [(TEXTS["en"], "nb"), (TEXTS["de"], "ru"), (ALL["zh"], "el")] * 6)


def names(model, text):
    return [k for k, *_ in L.summary(L.segment(model, text))]


def test_languages_and_mixtures(model):
    for k, v in ALL.items():
        assert names(model, v) == [k]
    assert sorted(names(model, TEXTS["nb"] + "\n\n" + GREEK)) == ["el", "nb"]
    assert sorted(names(model, TEXTS["de"] + "\n\n" + TEXTS["en"])) == ["de", "en"]
    assert names(model, TEXTS["en"] + " (Sturm und Stille)") == ["en"]
    assert L.segment(model, "123 456") == [] and L.segment(model, "") == []


def test_languages_not_listed_are_rejected(model):
    for k, v in OTHERS.items():
        assert names(model, v) == ["und"], k
    assert names(model, TEXTS["nb"] + "\n\n" + OTHERS["uk"]) == ["nb"]
    unseen = "Россия расположена в Восточной Европе. Её столица Москва, где живёт много людей. Они каждый день говорят на русском языке."
    assert names(model, unseen) == ["ru"]  # hardly a word of it is in the training texts


def test_saved_model(spark, model, tmp_path):
    L.save_model(spark, model, f"file://{tmp_path}/model")
    again = L.load_model(spark, f"file://{tmp_path}/model")
    for v in [*ALL.values(), *OTHERS.values()]:
        assert L.segment(again, v) == L.segment(model, v)


def test_labels(spark):
    given = [("nob", "nb"), ("en-GB", "en"), (" NB ", "nb"), ("und", None), ("??", None), ("", None), (None, None), ("el", "el"), ("xx", None), ("nn_NO", "nn")]
    rows = spark.createDataFrame(given, "lang string, want string").select("want", L.normal_label().alias("got")).collect()
    assert [r["got"] for r in rows] == [w for _, w in given]


def test_found(spark):
    rows = [(i, ALL[k], k) for i, k in enumerate([*TEXTS, "el"] * 19)]
    rows += [(100, TEXTS["nn"], "nb"), (101, TEXTS["nb"], None), (102, TEXTS["nb"] + "\n\n" + GREEK, "nb"), (103, "12 34", None), (104, None, None), (105, TEXTS["en"], "en-US"), (106, "", "??"), (101, TEXTS["nb"], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as label", "2 as confidence")
    got = {tuple(r) for r in L.mislabelled(L.document_languages(docs)).collect()}
    assert got == {(100, "nn"), (101, "nb"), (102, "nb"), (102, "el")}
    assert L.document_languages(docs.limit(0)).count() == 0
    s = L.document_segments(docs.filter("doc_id = 102"), L.trained(docs)).orderBy("segment").collect()
    assert [r["lang"] for r in s] == ["nb", "el"]
