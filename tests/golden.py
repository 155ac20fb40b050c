"""A published evaluation of 30 articles and its report."""

# rouge1_f, rouge2_f, rougeL_f, processing_time_seconds, compression_rate,
# input_characters, summary_characters
DETAIL = [
    (0.5352112676056339, 0.37681159420289856, 0.47887323943661975, 5.828860078999924, 0.07032115171650055, 3612, 254),
    (0.4883720930232558, 0.2857142857142857, 0.4883720930232558, 6.546342080999921, 0.09438009438009438, 2331, 220),
    (0.4000000000000001, 0.20588235294117646, 0.2571428571428571, 5.942338192000079, 0.0499031007751938, 4128, 206),
    (0.39436619718309857, 0.17391304347826086, 0.3380281690140845, 3.4725440600000184, 0.13685978169605373, 1191, 163),
    (0.4155844155844156, 0.1333333333333333, 0.2077922077922078, 4.664943332000121, 0.09581963363081258, 2129, 204),
    (0.23728813559322035, 0.035087719298245605, 0.13559322033898305, 4.8913244729999406, 0.07449297971918876, 2564, 191),
    (0.3111111111111111, 0.04545454545454545, 0.17777777777777776, 5.663156565999998, 0.040174854288093254, 4804, 193),
    (0.3283582089552239, 0.09230769230769229, 0.2388059701492537, 3.772722316999989, 0.06606890042472864, 2119, 140),
    (0.3389830508474576, 0.10526315789473684, 0.2033898305084746, 3.990267587000062, 0.09803921568627451, 1683, 165),
    (0.5306122448979592, 0.3829787234042554, 0.5306122448979592, 3.137704764999853, 0.2492063492063492, 630, 157),
    (0.4838709677419355, 0.19999999999999998, 0.3870967741935484, 3.239383375999978, 0.2478386167146974, 694, 172),
    (0.1846153846153846, 0.031746031746031744, 0.12307692307692307, 6.285866922999958, 0.08194984104556693, 2831, 232),
    (0.4, 0.17647058823529413, 0.37142857142857144, 5.765737002999913, 0.08231173380035026, 2855, 235),
    (0.15624999999999997, 0.0, 0.09374999999999999, 10.732399290999865, 0.08213843158081076, 5649, 464),
    (0.23728813559322032, 0.14035087719298245, 0.16949152542372883, 5.428432366999914, 0.14638665843113033, 1619, 237),
    (0.15384615384615383, 0.0, 0.07692307692307691, 5.703109715999972, 0.0324017199017199, 6512, 211),
    (0.48, 0.3013698630136986, 0.39999999999999997, 5.958279693999884, 0.0607909604519774, 4425, 269),
    (0.21978021978021978, 0.022471910112359546, 0.13186813186813187, 7.096139120000089, 0.035684298908480266, 7146, 255),
    (0.5333333333333333, 0.27586206896551724, 0.4666666666666667, 6.230880922000097, 0.041068580542264754, 5016, 206),
    (0.32876712328767127, 0.14084507042253522, 0.24657534246575344, 5.430891680000059, 0.09809725158562368, 2365, 232),
    (0.20512820512820512, 0.02631578947368421, 0.15384615384615383, 6.524582328999941, 0.041448770094906065, 5163, 214),
    (0.2191780821917808, 0.028169014084507043, 0.0821917808219178, 5.0639740789999905, 0.036538847620959644, 4981, 182),
    (0.30769230769230765, 0.02631578947368421, 0.10256410256410256, 6.117823394999959, 0.03736263736263736, 5460, 204),
    (0.48484848484848486, 0.28125, 0.30303030303030304, 4.003924067999833, 0.09952153110047847, 2090, 208),
    (0.4507042253521127, 0.2608695652173913, 0.3380281690140845, 5.142579710000064, 0.09995936611133685, 2461, 246),
    (0.2222222222222222, 0.0, 0.17777777777777778, 6.705125079000027, 0.0488997555012225, 6135, 300),
    (0.39999999999999997, 0.15873015873015875, 0.21538461538461542, 5.307357708999916, 0.14501510574018128, 1655, 240),
    (0.2105263157894737, 0.07272727272727272, 0.14035087719298245, 5.50755307899999, 0.08753202391118702, 2342, 205),
    (0.3728813559322034, 0.10526315789473684, 0.20338983050847456, 5.594574921000003, 0.060263653483992465, 3717, 224),
    (0.37500000000000006, 0.2903225806451613, 0.34375, 6.243115985000031, 0.06725958866036687, 3598, 242),
]
REPORT = {
    "model_name": "facebook/bart-large-cnn",
    "dataset": "abisee/cnn_dailymail (3.0.0), test split",
    "num_samples": 30,
    "rouge1_f_mean": 0.3469,
    "rouge2_f_mean": 0.1459,
    "rougeL_f_mean": 0.2528,
    "processing_time_seconds_mean": 5.53,
    "processing_time_seconds_p95": 6.92,
    "compression_rate_mean": 0.0869,
}
