"""Documents with known totals, from orders and their lines; D2: the values expected of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import format_number, in_words, make_gstin

from .states import STATES


def order_lines(lineitem: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """Lines of orders in their order, with whole-cent prices whose product is exact."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    qty = F.col("l_quantity").cast("long")
    lines = lineitem.withColumn("position", F.row_number().over(order)).withColumn("qty", qty)
    lines = lines.withColumn("unit_cents", F.floor(F.col("l_extendedprice") * 100 / F.col("qty") + 0.5).cast("long"))
    lines = lines.withColumn("line_cents", F.col("qty") * F.col("unit_cents"))
    if part is not None:
        lines = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("label")), "l_partkey", "left")
    return lines


def totals(lines: DataFrame) -> DataFrame:
    """V1 on order lines: subtotal, tax and total of each order, in cents."""
    bp = F.when(F.col("l_orderkey") % 4 == 0, 0).when(F.col("l_orderkey") % 4 == 1, 500).when(F.col("l_orderkey") % 4 == 2, 1200).otherwise(1800)
    sums = lines.groupBy("l_orderkey").agg(F.sum("line_cents").alias("subtotal"), F.count(F.lit(1)).alias("n_lines"))
    return sums.withColumn("tax_bp", bp.cast("long")).withColumn("tax", F.expr("(subtotal * tax_bp + 5000) div 10000")).withColumn("total", F.expr("subtotal + tax"))


def _gathered(lines: DataFrame, row: Column) -> DataFrame:
    """Orders with their lines' texts in order, their subtotal, and the first line's supplier and quantity."""
    first = lambda c: F.min_by(c, "position")
    found = lines.withColumn("_row", row).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("position", "_row"))).alias("_rows"), F.sum("line_cents").alias("subtotal"), first("l_suppkey").alias("suppkey"), first("qty").alias("first_qty")
    )
    return found.withColumn("rows", F.col("_rows._row")).drop("_rows")


def order_documents(orders: DataFrame, lineitem: DataFrame, part: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """``(doc_id, layout, text, subtotal, tax, total)``: one document for each order that has lines.

    Lines are gathered per order, of which there are a few; layouts are proforma, tax invoice and retail in turn.
    """
    # Rendering is heavy for its bytes: a set number of partitions keeps it from being merged into a few tasks.
    parts = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = order_lines(lineitem.repartition(parts, "l_orderkey"), part)
    bp = F.when(F.col("l_orderkey") % 4 == 0, 0).when(F.col("l_orderkey") % 4 == 1, 500).when(F.col("l_orderkey") % 4 == 2, 1200).otherwise(1800).cast("long")
    cols = lambda *parts: F.concat_ws("  ", *parts)
    money, place, label, qty, unit, amount = format_number, F.col("position").cast("string"), F.col("label"), F.col("qty").cast("string"), F.col("unit_cents"), F.col("line_cents")
    percent = lambda bp: (bp / 100).cast("int").cast("string")
    gross = F.floor(unit * (10000 + bp) / 10000 + 0.5).cast("long")
    # A line is a text before lines are gathered, in the row of its own.
    row = F.when(F.col("l_orderkey") % 3 == 0, cols(place, label, qty, money(unit), money(amount))).when(
        F.col("l_orderkey") % 3 == 1, cols(place, label, F.concat(percent(bp), F.lit("%")), F.concat(qty, F.lit(" pcs")), money(gross), money(unit), F.lit("pcs"), money(amount))
    ).otherwise(cols(label, qty, money(unit), money(amount)))
    gathered = _gathered(lines, row)
    docs = gathered.join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    docs = docs.withColumn("tax_bp", bp).withColumn("tax", F.expr("(subtotal * tax_bp + 5000) div 10000")).withColumn("total", F.expr("subtotal + tax"))
    # Numbers of parties are made once for each party; those of parties without a row count as of nation 0.
    own = lambda nation, key: make_gstin(F.coalesce(nation, F.lit(0)) + 1, F.col(key))
    docs = docs.join(supplier.select(F.col("s_suppkey").alias("suppkey"), own("s_nationkey", "s_suppkey").alias("_seller_id")), "suppkey", "left")
    docs = docs.join(customer.select(F.col("c_custkey").alias("o_custkey"), own("c_nationkey", "c_custkey").alias("_buyer_id")), "o_custkey", "left")
    number = F.format_string("%d", F.col("l_orderkey"))
    seller, buyer = F.concat(F.lit("Firm "), F.col("suppkey"), F.lit(" LLP")), F.concat(F.lit("Trader "), F.col("o_custkey"), F.lit(" Pvt Ltd"))
    seller_id, buyer_id = F.coalesce("_seller_id", make_gstin(F.lit(1), F.col("suppkey"))), F.coalesce("_buyer_id", make_gstin(F.lit(1), F.col("o_custkey")))
    date, percent = F.date_format("o_orderdate", "dd/MM/yyyy"), percent(F.col("tax_bp"))
    proforma = F.concat(
        F.array(F.lit("PROFORMA INVOICE"), F.lit("Sold to"), cols(buyer, F.concat(F.lit("PI No: PI-"), number), F.concat(F.lit("Date : "), date)), F.lit("Project site, Gujarat, India"), F.concat(F.lit("GST No. "), buyer_id), F.lit("PAYMENT TERM:- 100% Advance"), F.lit("SR.  PRODUCT DESCRIPTION  QTY  UNIT  AMOUNT RS.")),
        F.col("rows"),
        F.array(cols(F.lit("TAXABLE"), money(F.col("subtotal"))), cols(F.concat(F.lit("GST @ "), percent, F.lit("%")), money(F.col("tax"))), cols(F.lit("Sub Total"), money(F.col("total"))), F.lit("TCS  -"), F.lit("Round Off (+/-)  -"), cols(F.lit("Rs. Amount in words only"), F.lit("TOTAL"), money(F.col("total"))), seller, F.concat(F.lit("GST No. "), seller_id)),
    )
    some = lambda text: F.when(F.col("tax") > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    tax_invoice = F.concat(
        F.array(F.lit("TAX INVOICE"), cols(seller, F.concat(F.lit("Invoice No. INV/"), number), date), F.concat(F.lit("GSTIN/UIN: "), seller_id), F.lit("Buyer (Bill to)"), buyer, F.concat(F.lit("GSTIN/UIN: "), buyer_id), F.lit("Description of Goods  GST  Quantity  Rate(Incl of Tax)  Rate  Amount")),
        F.col("rows"),
        some(cols(F.lit("IGST"), money(F.col("tax")))),
        F.array(cols(F.lit("On Account"), F.concat(money(F.col("total")), F.lit(" Dr"))), cols(F.lit("Total"), F.concat(F.col("first_qty").cast("string"), F.lit(" pcs")), F.concat(F.lit("₹ "), money(F.col("total"))))),
        some(cols(F.lit("Total"), money(F.col("subtotal")), money(F.col("tax")), money(F.col("tax")))),
    )
    half = F.expr("(tax + 1) div 2")
    half_rate = F.regexp_replace(F.concat((F.col("tax_bp") / 200).cast("int").cast("string"), F.when(F.col("tax_bp") % 200 != 0, ".5").otherwise("")), "$", "%")
    retail = F.concat(
        F.array(F.lit("INVOICE"), seller, F.concat(F.lit("Invoice #: INV/"), number), F.concat(F.lit("Date: "), date), F.lit("Item  Qty  Rate  Amount")),
        F.col("rows"),
        F.array(cols(F.lit("Subtotal"), money(F.col("subtotal")))),
        some(cols(F.concat(F.lit("CGST "), half_rate), money(half))), some(cols(F.concat(F.lit("SGST "), half_rate), money(F.col("tax") - half))),
        F.array(cols(F.lit("Grand Total"), F.concat(F.lit("Rs. "), money(F.col("total")))), cols(F.lit("Amount Paid"), money(F.col("total")))),
    )
    layout = F.when(F.col("l_orderkey") % 3 == 0, "proforma").when(F.col("l_orderkey") % 3 == 1, "tax-invoice").otherwise("retail")
    text = F.when(F.col("l_orderkey") % 3 == 0, proforma).when(F.col("l_orderkey") % 3 == 1, tax_invoice).otherwise(retail)
    return docs.select(F.col("l_orderkey").cast("string").alias("doc_id"), layout.alias("layout"), F.array_join(text, "\n").alias("text"), "subtotal", "tax", "total")


#: Families of vouchers in turn, with their titles and the head of their numbers.
VOUCHERS = [("proforma_invoice", "PROFORMA INVOICE", "PI-"), ("sales_invoice", "TAX INVOICE", "INV/"), ("purchase_invoice", "PURCHASE INVOICE", "PUR/"), ("credit_note", "CREDIT NOTE", "CN/"), ("debit_note", "DEBIT NOTE", "DN/")]


def voucher_documents(orders: DataFrame, lineitem: DataFrame, part: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """``(doc_id, family, text)``: a voucher for each order that has lines, five families in two layouts.

    Items stand in columns of fixed width. Tax is split where both parties are of one state; proformas print one sum.
    """
    # Rendering is heavy for its bytes: a set number of partitions keeps it from being merged into a few tasks.
    parts = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = order_lines(lineitem.repartition(parts, "l_orderkey"), part)
    bp = F.when(F.col("l_orderkey") % 4 == 0, 0).when(F.col("l_orderkey") % 4 == 1, 500).when(F.col("l_orderkey") % 4 == 2, 1200).otherwise(1800).cast("long")
    percent = lambda bp: F.concat((bp / 100).cast("int").cast("string"), F.lit("%"))
    money, text = format_number, lambda s: F.lit(s)

    def row(position: Column, label: Column, hsn: Column, gst: Column, qty: Column, unit: Column, rate: Column, amount: Column) -> Column:
        return F.rtrim(F.concat(F.rpad(position, 4, " "), F.rpad(label, 60, " "), F.lpad(hsn, 8, " "), F.lpad(gst, 8, " "), F.lpad(qty, 8, " "), F.lit("  "), F.rpad(unit, 6, " "), F.lpad(rate, 16, " "), F.lpad(amount, 18, " ")))

    # A line is a text before lines are gathered, in the row of its own.
    gathered = _gathered(lines, row(
        F.col("position").cast("string"), F.col("label"), (F.col("l_partkey") % 9000 + 1000).cast("string"), percent(bp), F.col("qty").cast("string"), F.lit("pcs"), money(F.col("unit_cents")), money(F.col("line_cents")),
    ))
    docs = gathered.hint("merge").join(orders.withColumnRenamed("o_orderkey", "l_orderkey").hint("merge"), "l_orderkey")
    docs = docs.withColumn("tax_bp", bp).withColumn("tax", F.expr("(subtotal * tax_bp + 5000) div 10000")).withColumn("total", F.expr("subtotal + tax"))
    code = lambda c: F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(24)) + 1
    # Numbers of parties are made once for each party; those of parties without a row count as of nation 0. Buyers are
    # second entities: a supplier and a customer of one key and state are two parties, which no number is shared by.
    own = lambda nation, key, entity=1: make_gstin(code(nation), F.col(key), entity)
    docs = docs.hint("merge").join(supplier.select(F.col("s_suppkey").alias("suppkey"), "s_nationkey", own("s_nationkey", "s_suppkey").alias("_seller_id")).hint("merge"), "suppkey", "left")
    docs = docs.hint("merge").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", own("c_nationkey", "c_custkey", 2).alias("_buyer_id")).hint("merge"), "o_custkey", "left")
    names = F.create_map(*[F.lit(x) for c, n in STATES for x in (int(c), n)])
    docs = docs.withColumn("seller_code", code("s_nationkey")).withColumn("buyer_code", code("c_nationkey"))
    seller, buyer = F.concat(F.lit("Firm "), F.col("suppkey"), F.lit(" LLP")), F.concat(F.lit("Trader "), F.col("o_custkey"), F.lit(" Pvt Ltd"))
    seller_id, buyer_id = F.coalesce("_seller_id", make_gstin(F.lit(1), F.col("suppkey"))), F.coalesce("_buyer_id", make_gstin(F.lit(1), F.col("o_custkey"), 2))
    seller_state, buyer_state = F.element_at(names, F.col("seller_code").cast("int")), F.element_at(names, F.col("buyer_code").cast("int"))
    kind = F.col("l_orderkey") % len(VOUCHERS)
    pick = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in VOUCHERS]), (kind + 1).cast("int"))
    number, date = F.concat(pick(2), F.col("l_orderkey")), F.date_format("o_orderdate", "dd/MM/yyyy")
    cols = lambda *parts: F.concat_ws("  ", *parts)
    percent = percent(F.col("tax_bp"))
    head = row(*[F.lit(x) for x in ("Sl", "Description of Goods", "HSN/SAC", "GST", "Qty", "Unit", "Rate", "Amount")])
    proforma = F.concat(
        F.array(text("PROFORMA INVOICE"), text("Sold to"), cols(buyer, F.concat(F.lit("PI No: "), number), F.concat(F.lit("Date : "), date)), F.concat(F.col("o_custkey"), F.lit(", Business Park, "), buyer_state), F.concat(F.lit("GST No. "), buyer_id), text("PAYMENT TERM:- 100% Advance"), head),
        F.col("rows"),
        F.array(
            cols(text("TAXABLE"), money(F.col("subtotal"))), cols(F.concat(F.lit("GST @ "), percent), money(F.col("tax"))), cols(text("Sub Total"), money(F.col("total"))),
            cols(text("Round Off (+/-)"), text("0.00")), cols(text("TOTAL"), money(F.col("total"))), text("Supplier"), seller, F.concat(F.lit("GST No. "), seller_id),
        ),
    )
    some = lambda condition, *parts: F.when(condition, F.array(*parts)).otherwise(F.array().cast("array<string>"))
    half = F.expr("(tax + 1) div 2")
    apart = F.col("seller_code") != F.col("buyer_code")
    others = F.concat(
        F.array(
            pick(1), cols(seller, F.concat(F.when(kind == 1, "Invoice").otherwise("Voucher"), F.lit(" No. "), number), F.concat(F.lit("Dated "), date)), text("Supplier (From)"), seller,
            F.concat(F.col("suppkey"), F.lit(", Industrial Estate, "), seller_state), F.concat(F.lit("GSTIN/UIN: "), seller_id), text("Buyer (Bill to)"), buyer,
            F.concat(F.col("o_custkey"), F.lit(", Business Park, "), buyer_state), F.concat(F.lit("GSTIN/UIN: "), buyer_id), F.concat(F.lit("Place of Supply : "), buyer_state), head,
        ),
        F.col("rows"),
        F.array(cols(text("Taxable Value"), money(F.col("subtotal")))),
        some((F.col("tax") > 0) & apart, cols(text("IGST"), money(F.col("tax")))),
        some((F.col("tax") > 0) & ~apart, cols(text("CGST"), money(half)), cols(text("SGST"), money(F.col("tax") - half))),
        F.array(cols(text("Total"), F.concat(F.lit("Rs. "), money(F.col("total"))))),
    )
    return docs.select(F.col("l_orderkey").cast("string").alias("doc_id"), pick(0).alias("family"), F.array_join(F.when(kind == 0, proforma).otherwise(others), "\n").alias("text"))


def read_voucher_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "part", "customer", "supplier")}
    return voucher_documents(t["orders"], t["lineitem"], t["part"], t["customer"], t["supplier"])


def read_order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "part", "customer", "supplier")}
    return order_documents(t["orders"], t["lineitem"], t["part"], t["customer"], t["supplier"])


#: What is wrong with the offers of :func:`rival_candidates`, by order key modulo 12.
RIVALS = [
    "none", "seller_number_invalid", "buyer_number_is_sellers", "seller_name_is_address", "seller_name_is_title", "buyer_name_is_sellers", "place_unknown", "taxable_halved", "both_taxes",
    "discount", "total_is_taxable", "half_a_split",
]


def rival_candidates(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, supplier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field candidates of vouchers with known values, one rival of a kind (``RIVALS``) among those of each order.

    ``(doc_id, field, value, num, score, line_text, rank)``, and ``(doc_id, line_sum)``, which is 0 for odd orders.
    """
    lines = order_lines(lineitem)
    sums = totals(lines).hint("merge").join(lines.where("position = 1").select("l_orderkey", F.col("l_suppkey").alias("suppkey")).hint("merge"), "l_orderkey")
    docs = sums.hint("merge").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").hint("merge"), "l_orderkey")
    docs = docs.hint("merge").join(supplier.select(F.col("s_suppkey").alias("suppkey"), "s_nationkey").hint("merge"), "suppkey", "left")
    docs = docs.hint("merge").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").hint("merge"), "o_custkey", "left")
    code = lambda c: F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(24)) + 1
    names = F.create_map(*[F.lit(x) for c, n in STATES for x in (int(c), n)])
    docs = docs.withColumn("seller_code", code("s_nationkey")).withColumn("buyer_code", code("c_nationkey"))
    docs = docs.withColumn("seller_id", make_gstin(F.col("seller_code"), F.col("suppkey"))).withColumn("buyer_id", make_gstin(F.col("buyer_code"), F.col("o_custkey")))
    docs = docs.withColumn("rival", F.element_at(F.array(*map(F.lit, RIVALS)), (F.col("l_orderkey") % len(RIVALS) + 1).cast("int")))
    seller, buyer = F.concat(F.lit("Firm "), F.col("suppkey"), F.lit(" LLP")), F.concat(F.lit("Trader "), F.col("o_custkey"), F.lit(" Pvt Ltd"))
    state = F.element_at(names, F.col("buyer_code").cast("int"))
    last = F.substring("seller_id", 15, 1)
    worn = F.concat(F.substring("seller_id", 1, 14), F.when(last == "A", "B").otherwise("A"))
    is_ = lambda rival: F.col("rival") == rival
    none = F.lit(None)

    def offer(field: str, score: int, text: Column = none, amount: Column = none, line: Column = none) -> Column:
        return F.struct(F.lit(field).alias("field"), text.cast("string").alias("value"), amount.cast("long").alias("num"), F.lit(score).alias("score"), line.cast("string").alias("line_text"))

    apart, taxed = F.col("seller_code") != F.col("buyer_code"), F.col("tax") > 0
    half = F.expr("(tax + 1) div 2")
    both = is_("both_taxes")
    each = F.array(
        F.when(is_("seller_number_invalid"), offer("seller.gstin", 60, worn)), offer("seller.gstin", 58, F.col("seller_id")),
        F.when(is_("buyer_number_is_sellers"), offer("buyer.gstin", 59, F.col("seller_id"))), offer("buyer.gstin", 46, F.col("buyer_id")),
        F.when(is_("seller_name_is_address"), offer("seller.name", 47, F.concat(F.lit("Plot "), F.col("suppkey"), F.lit(", Gujarat")))), F.when(is_("seller_name_is_title"), offer("seller.name", 47, F.lit("TAX INVOICE"))),
        offer("seller.name", 44, seller), F.when(is_("buyer_name_is_sellers"), offer("buyer.name", 45, seller)), offer("buyer.name", 44, buyer),
        F.when(is_("place_unknown"), offer("document.place_of_supply", 50, F.lit("Elsewhere Abroad"))), F.when(is_("place_unknown") | (F.col("l_orderkey") % 3 == 1), offer("document.place_of_supply", 48, state)),
        F.when(is_("taxable_halved"), offer("amounts.taxable_amount_cents", 72, amount=F.expr("subtotal div 2"))), offer("amounts.taxable_amount_cents", 70, amount=F.col("subtotal")),
        F.when(F.col("l_orderkey") % 4 != 0, offer("amounts.subtotal_cents", 48, amount=F.col("total"))), F.when(is_("discount"), offer("amounts.discount_cents", 46, amount=F.lit(100000))),
        F.when(taxed & (apart | both), offer("taxes.igst_cents", 68, amount=F.col("tax"))), F.when(taxed & (~apart | both), offer("taxes.cgst_cents", 60, amount=half)),
        F.when(taxed & (~apart | both) & ~is_("half_a_split"), offer("taxes.sgst_cents", 60, amount=F.col("tax") - half)),
        F.when(is_("total_is_taxable"), offer("amounts.grand_total_cents", 80, amount=F.col("subtotal"), line=F.lit("IGST 18%"))), offer("amounts.grand_total_cents", 76, amount=F.col("total"), line=F.lit("Grand Total")),
    )
    # A field's offers are numbered in the order's own row.
    offers = F.transform("_offers", lambda c, i: c.withField("rank", F.size(F.filter(F.slice("_offers", 1, i + 1), lambda d: d.field == c.field))))
    found = docs.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.array_compact(each).alias("_offers"))
    ranked = found.select("doc_id", F.inline(offers))
    return ranked, docs.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.when(F.col("l_orderkey") % 2 == 0, F.col("subtotal")).otherwise(0).alias("line_sum"))


def worn_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices for the rules of V7; by order number modulo 13, twelve of thirteen have an error of their kind."""
    m, first = F.col("l_orderkey") % 13, F.col("position") == 1
    worn = lambda kind, by, at=F.lit(True): F.when((m == kind) & at, by).otherwise(0)
    lines = order_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumn("_g", F.col("qty") * F.col("unit_cents"))
    lines = lines.withColumn("_d", F.floor(F.col("_g") * F.round(F.col("l_discount") * 100).cast("long") / 100).cast("long")).withColumn("_bp", F.floor(F.round(F.col("l_tax") * 10000) / 2).cast("long"))
    lines = lines.withColumn("_tax", F.floor((F.col("_g") - F.col("_d")) * F.col("_bp") / 10000).cast("long"))
    values = {
        "quantity_thousandths": F.col("qty") * 1000, "rate_cents": F.col("unit_cents"), "gross_cents": F.col("_g") + worn(2, 500, first), "discount_cents": F.col("_d"), "taxable_cents": F.col("_g") - F.col("_d") + worn(3, 1000, first),
        "cgst_bp": F.col("_bp"), "sgst_bp": F.col("_bp") + worn(4, 450), "cgst_cents": F.col("_tax"), "sgst_cents": F.col("_tax"), "igst_cents": worn(5, 100),
    }
    item = F.struct("position", *[c.cast("long").alias(n) for n, c in values.items()])
    # An order has few lines: they are one invoice.
    whole = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("line_items"), F.sum(F.col("_g") - F.col("_d")).alias("_net"), F.sum("_tax").alias("_tax"))
    total = F.col("_net") + 2 * F.col("_tax")
    footer = {
        "total_taxable_cents": F.col("_net") + worn(6, 5000), "total_cgst_cents": F.col("_tax") + worn(7, 500), "total_sgst_cents": F.col("_tax"), "total_igst_cents": F.lit(0), "total_cess_cents": F.lit(None),
        "other_charges_cents": F.lit(None), "round_off_cents": worn(10, 150), "grand_total_cents": total + worn(8, 10000) + worn(10, 150),
    }
    gstin = lambda by: make_gstin(F.col("l_orderkey") % 30 + 1, F.col("l_orderkey") + by)
    return whole.select(
        "l_orderkey", F.when(m != 11, F.concat(F.lit("INV/"), F.col("l_orderkey").cast("string"))).alias("invoice_number"), F.when(m == 12, "soon").otherwise("01/02/2024").alias("invoice_date"), F.lit(None).cast("string").alias("original_invoice_date"),
        F.when(m == 1, F.substring(gstin(0), 1, 14)).otherwise(gstin(0)).alias("seller_gstin"), gstin(1).alias("buyer_gstin"), F.concat(in_words(F.floor(total / 100) + worn(9, 7)), F.lit(" rupees only")).alias("grand_total_words"),
        F.transform("line_items", lambda x: x.dropFields("position")).alias("line_items"), F.struct(*[c.cast("long").alias(n) for n, c in footer.items()]).alias("footer"),
    )
