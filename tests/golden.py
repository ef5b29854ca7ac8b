"""Small vouchers with known records."""

DOCS = {
    "tax-invoice-core": """
TAX INVOICE
Ack Date    : 23-May-25
JAYRAJ SOLAR LLP                                       Invoice No.           29               Dated 23-May-25
Shop No. 225, Rajhans Stadium Plaza,
Surat-395009, Gujarat, India.
GSTIN/UIN: 24AAMFJ7876R1Z8
Consignee (Ship to)
Nimoto Solar Pvt Ltd
GSTIN/UIN       : 27AADCN3773B1ZM
Buyer (Bill to)
Nimoto Solar Pvt Ltd
GSTIN/UIN         : 27AADCN3773B1ZM
Place of Supply : Maharashtra
Sl         Description of Goods       HSN/SAC GST                  Quantity        Rate           Rate     per Disc. %        Amount
No.                                           Rate                             (Incl. of Tax)

 1 Supply and Installation           995442               18 % 250.000 KW        1,888.00         1,600.00 KW                4,00,000.00
   Structure, Electrical BOS
   supply, I&C for 250 KWp Solar
   Power Project at Sarigam, Gujarat

                                    IGST                                                                                       72,000.00
                                     Total                       250.000 KW                                                ₹ 4,72,000.00
""".strip(),
    "proforma-core": """
PROFORMA INVOICE
Sold to
JAYRAJ SOLAR LLP                                      PI No:          PI-0272/23-24               Date :      30/10/2023
225, Rajahans Stadium Plaza, Near LP Savani School,
Gujarat, 395009
GST No.       24AAMFJ7876R1Z8
PAYMENT TERM:- 100% Advance
SR.                                                                                            UNIT
                         PRODUCT DESCRIPTION                                  QTY                            AMOUNT RS.
NO.                                                                                           ( nos )
  1                          SOFAR-5KW G-3                                     5              29,600.00         148,000.00
                                                                                              TAXABLE           148,000.00
                                                                                            GST @ 12%            17,760.00
                                                                                              Sub Total         165,760.00
                                                                                                   TCS                 -
                                                                                          Round Off (+/-)              -
Rs. One Lacs Sixty Five Thousand Seven Hundred and Sixty Only                             TOTAL               165,760.00
GST No.       24AAACZ1284C1ZN
Zodiac Energy Ltd
""".strip(),
    "implicit-sales-core": """
#7782      11/07/25

KAPOOR & SONS
24ABCDE1111F1Z3

Client:
R K ENTERPRISES
24AAAAA2222G1Z4

Supply: Gujarat

Item        Qty   Price   Total
Tiles       200   50      10000

Tax 18%              1800

Final Amount         11800
""".strip(),
    "account-statement": """
ACCOUNT STATEMENT
Date Narration Debit Credit Balance
01/01/2026 Opening Balance 10,000.00
02/01/2026 UPI Payment 1,250.00 8,750.00
03/01/2026 Salary Credit 25,000.00 33,750.00
04/01/2026 Closing Balance 33,750.00
""".strip(),
    "nothing": "",
    "null": None,
}
