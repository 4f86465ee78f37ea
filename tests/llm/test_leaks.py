from umbra.llm import decontaminate


def test_items_of_one_text_have_no_threshold_for_the_question_alone(spark):
    question = [f"q{i}" for i in range(13)]
    answer = [f"a{i}" for i in range(70)]
    item = " ".join(question) + ". " + " ".join(answer)
    changed = item.replace("q1 ", "other ")  # 0.97 of the item's shingles, 0.78 of the question's
    docs = spark.createDataFrame([(1, "x " * 40 + changed + " y"), (2, " ".join(question))], "doc_id long, text string")
    one = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, one).collect()] == [(1, 7)]
    apart = spark.createDataFrame([(7, " ".join(question), " ".join(answer))], "item_id long, question string, answer string")
    assert decontaminate.find_leaks(docs, apart, question_col="question", answer_col="answer").count() == 0
